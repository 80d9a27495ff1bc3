"""Near-duplicates by DartMinHash signatures.

Elements are the five-word shingles of a text (a text with fewer words is one shingle). An element of
weight x owns x unit slices of a region that reaches to infinite rank. Darts
fall into every unit cell of (slice, rank) by a Poisson law with mean one, all of it
decided by hashes of the element, the slice and the cell, so every text that has the element sees the
same darts. Each dart belongs to one of the signature's coordinates, and a text keeps the earliest dart
per coordinate. Only the ranks up to a bound that leaves few coordinates empty are looked at; texts with an
empty coordinate are thrown again with the bound doubled. Two texts agree in a
coordinate with the probability of their (weighted) Jaccard similarity.

``bands`` groups of ``rows`` coordinates are the join keys. With 25 bands of 5 a pair at
similarity 0.8 meets in no band with probability 5e-5. Within a key, equal word sequences are one
text, and every text is paired with a few leaders of the key (its smallest, largest and smallest
after fixed scrambles). Pairs with the first leader are checked by exact Jaccard
similarity and closed into classes; of the pairs with the other leaders those between two classes are
checked after that, as the others cannot change a class. Texts that lead a key nowhere and are still in
different classes are then compared all with all, block by block, so every link of two texts with a
common key counts. Blocks hold few texts each, and two blocks of one class never meet; a crowd of texts
just below the similarity costs the square of its size in comparisons, spread over tasks of bounded size.

Defined results: null, empty and word-less texts are alone in their class; texts with equal word
sequences share a class; an empty table gives an empty table; null ids are kept and take the least
integer id of their class; other columns of the input are left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.llm.common import cut_lineage, document_keys, ship
from martwright.llm.components import components
from martwright.llm.textarrays import U, blocks, mix, shingles, text_column, words

ship(__name__)

# Chance that a cell holds at most 0, 1, 2, ... darts, in units of 2 ** -32 (Poisson, mean 1).
_TERMS = np.cumsum(1.0 / np.cumprod(np.append(1.0, np.arange(1.0, 13.0)))) / np.e
DARTS = (_TERMS * 2.0**32).astype(U)
# Scrambles that give a key's further leaders: fixed, so that keys of one group share them.
SCRAMBLES = tuple(int(x) for x in mix(np.arange(1, 4, dtype=U)).view(np.int64))
# Texts and words that a block of the last comparison holds on average, at most.
BLOCK_TEXTS, BLOCK_WORDS = 256, 50_000


def throw(
    elements: np.ndarray, of: np.ndarray, n: int, k: int, weighted: bool = False
) -> np.ndarray:
    """Signatures (n, k) of n sets: ranks of the earliest darts; sets without elements get inf.

    ``elements`` are hashes, ``of`` their sets. Repeated elements count once, or, if ``weighted``,
    as often as they occur.
    """
    if weighted and len(elements):
        order = np.lexsort((elements, of))
        elements, of = elements[order], of[order]
        same = np.append(False, (elements[1:] == elements[:-1]) & (of[1:] == of[:-1]))
        place = np.arange(len(of))
        turn = place - np.maximum.accumulate(np.where(same, 0, place))
        elements = mix(elements + turn.astype(U))
    best = np.full(n * k, np.inf)
    size = np.bincount(of, minlength=n)
    bound = np.ceil(k * (np.log(k) + 3) / np.maximum(size, 1)).astype(np.int64)
    open_sets = size > 0
    floor = np.zeros(n, dtype=np.int64)
    while open_sets.any():
        use = open_sets[of]
        e, s = elements[use], of[use]
        cells = (bound - floor)[s]
        at = np.repeat(np.arange(len(e)), cells)
        cell = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells) + floor[s][at]
        seed = mix(e[at] + cell.astype(U) * U(0xD6E8FEB86659FD93))
        count = np.searchsorted(DARTS, seed >> U(32), side="right")
        slot = s[at] * k
        for j in range(int(count.max(initial=0))):
            hit = np.flatnonzero(count > j)
            dart = mix(seed[hit] + U(j + 1))
            rank = cell[hit] + (dart >> U(11)).astype(np.float64) * 2.0**-53
            np.minimum.at(best, slot[hit] + ((dart & U(1023)) % U(k)).astype(np.int64), rank)
        open_sets &= np.isinf(best.reshape(n, k)).any(axis=1)
        floor, bound = bound, bound * 2
    return best.reshape(n, k)


def _signatures(width: int, bands: int, rows: int, weighted: bool):
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_column(batch.column(2))
            for first, last in blocks(offsets):
                n = last - first
                at = offsets[first : last + 1] - offsets[first]
                _, _, hashes, of = words(data[offsets[first] : offsets[last]], at)
                elements, owner = shingles(hashes, of, width)
                ranks = throw(elements, owner, n, k, weighted).view(U).reshape(n, bands, rows)
                keys = np.zeros((n, bands), dtype=U) + np.arange(1, bands + 1, dtype=U)
                for r in range(rows):
                    keys = mix(keys) ^ ranks[:, :, r]
                keys = mix(keys)
                counts = np.bincount(of, minlength=n)
                turn = np.arange(len(of)) - (np.cumsum(counts) - counts)[of]
                mixed = mix(hashes + turn.astype(U) * U(0xE7037ED1A0B428DB))
                text = np.zeros(n, dtype=U)
                np.add.at(text, of, mixed)
                text = mix(text + counts.astype(U))
                ends = np.append(0, np.cumsum(np.where(counts > 0, bands, 0))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[first:last],
                        batch.column(1)[first:last],
                        batch.column(3)[first:last],
                        pa.array(text.view(np.int64)),
                        pa.array(counts),
                        pa.ListArray.from_arrays(
                            pa.array(ends), pa.array(keys[counts > 0].ravel().view(np.int64))
                        ),
                    ],
                    names=["k1", "k2", "id", "word_key", "n_words", "bands"],
                )

    return run


def _shingle_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_column(batch.column(1))
            for first, last in blocks(offsets):
                at = offsets[first : last + 1] - offsets[first]
                _, _, hashes, of = words(data[offsets[first] : offsets[last]], at)
                elements, owner = shingles(hashes, of, width)
                order = np.lexsort((elements, owner))
                elements, owner = elements[order], owner[order]
                new = np.append(
                    np.ones(min(len(owner), 1), bool),
                    (elements[1:] != elements[:-1]) | (owner[1:] != owner[:-1]),
                )
                ends = np.append(0, np.cumsum(np.bincount(owner[new], minlength=last - first)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[first:last],
                        pa.ListArray.from_arrays(
                            pa.array(ends.astype(np.int32)),
                            pa.array(elements[new].view(np.int64)),
                        ),
                    ],
                    names=["node", "set"],
                )

    return run


def key_leaders(signed: DataFrame) -> DataFrame:
    """Leaders of every key that more than one text has, and its rows: key, l0, l1, ..., n_rows."""
    least = [
        F.min(F.col("word_key").bitwiseXOR(F.lit(x))).bitwiseXOR(F.lit(x)) for x in SCRAMBLES
    ]
    every = [F.min("word_key"), F.max("word_key"), *least]
    return (
        signed.select("word_key", F.explode("bands").alias("key"))
        .groupBy("key")
        .agg(*(c.alias(f"l{i}") for i, c in enumerate(every)), F.count(F.lit(1)).alias("n_rows"))
        .where("l0 <> l1")
    )


def _leader_names(leaders: DataFrame) -> list[str]:
    return [c for c in leaders.columns if c not in ("key", "n_rows")]


def candidate_pairs(signed: DataFrame, leaders: DataFrame) -> DataFrame:
    """Distinct (u, v, first), u < v, of texts and the leaders of a key that they have.

    ``first`` tells whether one of them is the first leader of such a key.
    """
    names = _leader_names(leaders)
    every = F.array(*(F.struct(F.col(c).alias("leader"), F.lit(c == "l0").alias("first")) for c in names))
    return (
        signed.select("word_key", F.explode("bands").alias("key"))
        .join(leaders, "key")
        .select("word_key", F.inline(F.array_distinct(every)))
        .where("word_key <> leader")
        .groupBy(
            F.least("word_key", "leader").alias("u"), F.greatest("word_key", "leader").alias("v")
        )
        .agg(F.max("first").alias("first"))
    )


def between_classes(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one class yet."""
    a = roots.select(F.col("node").alias("u"), F.col("root").alias("root_u"))
    b = roots.select(F.col("node").alias("v"), F.col("root").alias("root_v"))
    return (
        pairs.join(a, "u", "left")
        .join(b, "v", "left")
        .where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v"))
        .select("u", "v")
    )


def checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose exact Jaccard similarity is high enough."""
    a = sets.select(F.col("node").alias("u"), F.col("set").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("set").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return (
        pairs.join(a, "u")
        .join(b, "v")
        .where(both >= F.lit(similarity) * (F.size("a") + F.size("b") - both))
        .select("u", "v")
    )


def open_members(signed: DataFrame, leaders: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, root, n_words) of the texts that do not lead their key, in keys with several classes of them."""
    own = F.array(*_leader_names(leaders))
    crowded = leaders.where(F.col("n_rows") > F.size(F.array_distinct(own)))
    members = (
        signed.select(F.col("word_key").alias("node"), "n_words", F.explode("bands").alias("key"))
        .join(crowded, "key")
        .where(~F.array_contains(own, F.col("node")))
        .groupBy("key", "node")
        .agg(F.first("n_words").alias("n_words"))
        .join(roots, "node", "left")
        .select("key", "node", F.coalesce("root", "node").alias("root"), "n_words")
    )
    members = cut_lineage(members)
    several = members.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"))
    several = cut_lineage(several.where("a <> b").select("key"))
    return members.join(several, "key", "left_semi")


def block_pairs(members: DataFrame) -> DataFrame:
    """(key, pair, node, root, low): every text once for each pair of blocks that it is in.

    The classes of a key that fill more than a block have blocks of their own, which do not meet each other.
    """
    sums = (F.sum("n").alias("n"), F.sum("words").alias("words"))
    size = F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("words") / BLOCK_WORDS))
    classes = (
        members.groupBy("key", "root")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words"))
        .withColumn("mixed", size <= 1)
        .withColumn("part", F.when(F.col("mixed"), F.lit(0)).otherwise(F.col("root")))
    )
    classes = cut_lineage(classes)
    parts = classes.groupBy("key", "mixed", "part").agg(*sums).withColumn("size", size)
    parts = cut_lineage(parts.select("key", "mixed", "part", "size"))
    block = F.flatten(
        F.transform(
            F.collect_list(F.struct("mixed", "part", "size")),
            lambda p: F.transform(
                F.sequence(F.lit(0).cast("long"), p["size"] - 1),
                lambda i: F.struct(p["mixed"].alias("mixed"), p["part"].alias("part"), i.alias("salt")),
            ),
        )
    )
    every = cut_lineage(parts.groupBy("key").agg(block.alias("blocks")))
    salt = F.pmod(F.xxhash64("node"), F.col("size"))
    own, other = F.col("own"), F.col("other")
    return (
        members.join(classes.select("key", "root", "mixed", "part"), ["key", "root"])
        .join(parts, ["key", "mixed", "part"])
        .withColumn("own", F.struct("mixed", "part", salt.alias("salt")))
        .join(every, "key")
        .withColumn(
            "other",
            F.explode(
                F.filter("blocks", lambda x: x["mixed"] | own["mixed"] | (x["part"] != own["part"]))
            ),
        )
        .select(
            "key",
            F.xxhash64(F.least(own, other), F.greatest(own, other)).alias("pair"),
            "node",
            "root",
            (own == F.least(own, other)).alias("low"),
        )
    )


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Classes (node, root) after further ``links`` (u, v); without any they stay as they are."""
    if links.isEmpty():
        return roots
    stars = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    return components(stars.union(links))


def _common(values: np.ndarray, of: np.ndarray, n: int, columns: int = 4096) -> np.ndarray:
    """How many elements each two of ``n`` sets share."""
    _, place, count = np.unique(values, return_inverse=True, return_counts=True)
    kept = count[place] > 1
    number = np.cumsum(count > 1) - 1
    place, of = number[place[kept]], of[kept]
    order = np.argsort(place, kind="stable")
    place, of = place[order], of[order]
    out = np.zeros((n, n), dtype=np.float32)
    for first in range(0, int((count > 1).sum()), columns):
        a, b = np.searchsorted(place, [first, first + columns])
        part = np.zeros((n, columns), dtype=np.float32)
        part[of[a:b], place[a:b] - first] = 1
        out += part @ part.T
    return out


def _block_links(similarity: float):
    """Rows of ``block_pairs`` with their sets, sorted by key and pair, to links (u, v) between classes.

    Links that close a circle among the links of the same two blocks are left out.
    """

    def links(batch: pa.RecordBatch) -> list[tuple[int, int]]:
        node, root, low = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
        if (root == root[0]).all():
            return []
        ends = batch.column(5).offsets.to_numpy()
        sizes = np.diff(ends)
        of = np.repeat(np.arange(len(node)), sizes)
        both = _common(batch.column(5).values.to_numpy()[ends[0] : ends[-1]], of, len(node))
        both = both.astype(np.float64)
        alike = both >= similarity * (sizes[:, None] + sizes[None, :] - both)
        alike &= root[:, None] != root[None, :]
        if not low.all():
            alike &= low[:, None] != low[None, :]
        top = {}

        def find(x):
            while x in top:
                x = top[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(np.triu(alike, 1)), strict=True):
            a, b = find(int(root[i])), find(int(root[j]))
            if a != b:
                top[a] = b
                out.append((int(node[i]), int(node[j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                if held is not None:
                    table = pa.Table.from_batches([held, batch]).combine_chunks()
                    batch = table.to_batches()[0]
                key, pair = (batch.column(i).to_numpy() for i in (0, 1))
                cuts = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
                cuts = np.append(0, cuts)
                # the last two blocks may go on in the next batch
                whole, held = batch, batch.slice(int(cuts[-1])) if batch.num_rows else None
            elif held is None:
                break
            else:
                whole, cuts = held, np.array([0, held.num_rows])
            found = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                found += links(whole.slice(a, b - a))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["u", "v"]
                )

    return run


def near_duplicates(
    docs: DataFrame,
    *,
    similarity: float = 0.8,
    width: int = 5,
    bands: int = 25,
    rows: int = 5,
    weighted: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row: id, k1, k2 (the row's key), n_words, class_key, class_id, class_size."""
    kind = docs.schema[id_col].dataType
    keyed = docs.select(
        *document_keys(F.col(id_col), F.col(text_col), kind),
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
    )
    signed = cut_lineage(
        keyed.select("k1", "k2", "text", "id").mapInArrow(
            _signatures(width, bands, rows, weighted),
            f"k1 long, k2 long, id {kind.simpleString()}, word_key long, n_words long,"
            " bands array<long>",
        )
    )
    # Written first, so that the join reads plain shuffles on both sides and a hot key is split.
    leaders = cut_lineage(key_leaders(signed))
    pairs = cut_lineage(candidate_pairs(signed, leaders))
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select("v"))
    nodes = cut_lineage(ends.distinct())
    speakers = (
        signed.where("n_words > 0")
        .join(nodes, F.col("word_key") == F.col("node"))
        .groupBy("node")
        .agg(F.min(F.struct("k1", "k2")).alias("at"))
        .select("node", "at.k1", "at.k2")
    )
    sets = (
        keyed.select("k1", "k2", "text")
        .join(speakers, ["k1", "k2"])
        .groupBy("node")
        .agg(F.first("text").alias("text"))
        .mapInArrow(_shingle_sets(width), "node long, set array<long>")
    )
    sets = cut_lineage(sets)
    links = cut_lineage(checked(pairs.where("first"), sets, similarity))
    roots = components(links)
    open_pairs = between_classes(pairs.where("not first"), roots)
    roots = joined(roots, cut_lineage(checked(open_pairs, sets, similarity)))
    members = cut_lineage(open_members(signed, leaders, roots))
    if not members.isEmpty():
        blocks_of = (
            cut_lineage(block_pairs(members))
            .join(sets, "node")
            .select("key", "pair", "node", "root", "low", "set")
            .repartition("key", "pair")
            .sortWithinPartitions("key", "pair")
        )
        # a text without a link so far stands for its own class
        roots = joined(
            roots, cut_lineage(blocks_of.mapInArrow(_block_links(similarity), "u long, v long"))
        )
    classed = (
        signed.select("k1", "k2", "id", "n_words", "word_key")
        .join(roots.withColumnRenamed("node", "word_key"), "word_key", "left")
        .select(
            "k1",
            "k2",
            "id",
            "n_words",
            F.when(F.col("n_words") > 0, F.coalesce("root", "word_key"))
            .otherwise(F.col("k1"))
            .alias("class_key"),
            (F.col("n_words") > 0).alias("worded"),
        )
    )
    # A document without an id names no class; ``class_key`` tells classes apart whatever the ids.
    own = F.when(F.col("id").isNotNull(), F.col("k2"))
    named = cut_lineage(
        classed.groupBy("class_key", "worded").agg(
            F.min(own).alias("class_id"), F.count(F.lit(1)).alias("class_size")
        )
    )
    return classed.join(named, ["class_key", "worded"]).select(
        F.col("id").alias(id_col), "k1", "k2", "n_words", "class_key", "class_id", "class_size"
    )
