"""Near-duplicate documents by bottom-k sketches from one hash function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm import components
from skerry.llm import textkit as tk
from skerry.llm.store import scratch, written
from skerry.llm.textkit import U

#: Words in a shingle, and the similarity of a link as a fraction: 100 * shared >= 75 * union.
SHINGLE, LINK = 5, (75, 100)
#: Values in a sketch: those that are inverted, those that an estimate takes, and the deep sketch of unsafe classes.
INVERTED, ESTIMATE, DEEP = 24, 32, 256
#: Least values that the deep sketches of a link share, where both sets are larger than a sketch: fewer are met with a probability of 3.1e-9.
DEEP_SHARED = 150
#: The same where just one set is larger, so that the other's sketch is its whole set: fewer are met with a probability under 1e-9.
MIXED_SHARED = 174
#: Documents in a list whose pairs are formed directly; in longer lists each meets a hub instead.
SHORT_LIST = 16
#: Inverted values in long lists that a class may have and be safe: a link is then missed only if its sketches share no more values than
#: these, of INVERTED each with a probability of 3/4 at the least: 3.4e-9.
HOT = 4
#: Least estimates that are verified: for a link, of ESTIMATE values (fewer are met with a probability of 4.2e-9); and for what a hub's other
#: members may link with, of DEEP values: at a Jaccard of 1/2 128 are expected, and under 80 are met with a probability of 4.2e-10.
FLOOR, HUB_FLOOR = 9 / ESTIMATE, 80 / DEEP
#: Classes in a block; a task compares two blocks.
CROSS_ROWS = 512
#: Shingles, of both sides of all its pairs, that a cell of pairs has in the mean.
CELL_WORK = 1 << 19
#: What a list may hold to have its pairs formed grows by this factor with every round of hubs that left it unsettled.
PATIENCE = 4


def shingles(texts: pa.Array, width: int = SHINGLE) -> list[np.ndarray]:
    """Each text's set of shingles, A-Z lower-cased, as sorted 63-bit hashes; a text of fewer words is one shingle, one of none has none."""
    w = tk.words(texts, tk.SPACE, tk.LOWER)
    rolled = tk.mix(tk.windows(w.hash, width))
    out = []
    for a, b in zip(w.rows[:-1], w.rows[1:], strict=True):
        if b - a >= width:
            h = rolled[a : b - width + 1]
        elif b > a:
            h = tk.mix(tk.windows(w.hash[a:b], int(b - a)) ^ U(0xA0761D6478BD642F * int(b - a) & 0xFFFFFFFFFFFFFFFF))
        else:
            h = w.hash[:0]
        out.append(np.unique(h >> U(1)).astype(np.int64))
    return out


def sketched(docs: DataFrame, most: int = ESTIMATE) -> DataFrame:
    """doc_id, n (the set's size), mark (a 128-bit digest of the set) and sketch (its `most` lowest values, in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.chunks(batches, "text"):
            sets = shingles(batch.column(1))
            low = [s[:most] for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in low])])
            sketch = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*low, np.empty(0, np.int64)]), pa.int64()))
            marks = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()), sketch], ["doc_id", "n", "mark", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, mark binary, sketch array<long>")


def _alike(n: Column, m: Column) -> Column:
    """Sizes that a link's sets can have."""
    return LINK[1] * F.least(n, m) >= LINK[0] * F.greatest(n, m)


def _lists(flat: DataFrame, name: str) -> DataFrame:
    """Inverted lists of (rep, n, v) rows: v, rep, n, and c, the list's length; values of one class only are left out."""
    counts = flat.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    return written(flat.join(counts, "v"), name)


def _short_pairs(lists: DataFrame, most: int = SHORT_LIST) -> DataFrame:
    """Pairs (a, b, w) of classes, of different components where those are given, that share a value whose list is short; w sums their sizes."""
    comp = F.col("comp") if "comp" in lists.columns else F.col("rep")
    indexed = F.col("indexed") if "indexed" in lists.columns else F.lit(True)
    work = F.col("c") * F.col("ci") if "ci" in lists.columns else F.col("c") * F.col("c")
    short = lists.where(work <= most * most).select("v", "rep", "n", comp.alias("ca"), indexed.alias("ia"))
    other = short.select(F.col("v").alias("w"), F.col("rep").alias("b"), F.col("n").alias("m"), F.col("ca").alias("cb"), F.col("ia").alias("ib"))
    meets = (F.col("v") == F.col("w")) & (F.col("rep") < F.col("b")) & (F.col("ca") != F.col("cb")) & _alike(F.col("n"), F.col("m"))
    met = short.join(other, meets & ((F.col("ia") & (F.col("n") <= F.col("m"))) | (F.col("ib") & (F.col("m") <= F.col("n")))))
    return met.select(F.col("rep").alias("a"), "b", (F.col("n") + F.col("m")).alias("w")).distinct()


def _unsafe(classes: DataFrame, lists: DataFrame) -> DataFrame:
    """mark of classes of whose inverted values more stand in long lists than a link's other values make up for."""
    long_ = lists.where(F.col("c") > SHORT_LIST).groupBy("rep").agg(F.count("*").alias("hot"))
    held = F.least(F.size("sketch"), F.lit(INVERTED))
    return classes.join(long_, "rep").where((F.col("hot") > HOT) | (LINK[1] * F.col("hot") >= LINK[0] * held)).select("rep", "mark")


def _deep(unsafe: DataFrame, texts: DataFrame) -> DataFrame:
    """rep, n and a sketch of DEEP values of each unsafe class: up to DEEP shingles the whole set."""
    own = sketched(texts, DEEP).join(unsafe, "mark", "left_semi")
    return written(own.groupBy("mark").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).drop("mark"), "deep")


def _prefixes(deep: DataFrame) -> DataFrame:
    """rep, n, v, indexed: of each deep sketch the rarest values, so many that a link must share one of them.

    Sets that share at least k values meet among the first (size - k + 1) of each in any common order. Of two sets of up to DEEP
    shingles, which are their own sketches, k is 3/4 of the larger set and 6/7 of the smaller: as the smaller one of a pair, a class is
    known by its `indexed` values alone. A set so large that its partner may be larger than a sketch shares MIXED_SHARED
    values with that sketch, two larger sets' sketches share DEEP_SHARED: the longest prefix that any partner asks for is taken.
    """
    flat = deep.select("rep", "n", F.explode("sketch").alias("v"))
    counts = flat.groupBy("v").agg(F.count("*").alias("c"))
    w = Window.partitionBy("rep").orderBy("c", "v")
    n, both = F.col("n"), LINK[0] + LINK[1]
    mixed = F.when(LINK[1] * n >= LINK[0] * (DEEP + 1), n - MIXED_SHARED + 1).otherwise(F.lit(0))
    large = F.lit(DEEP - DEEP_SHARED + 1)
    length = F.when(n <= DEEP, F.greatest(n - F.ceil(n * LINK[0] / LINK[1]) + 1, mixed)).otherwise(large)
    own = F.when(n <= DEEP, F.greatest(n - F.ceil(n * 2 * LINK[0] / both) + 1, mixed)).otherwise(large)
    return flat.join(counts, "v").withColumn("k", F.row_number().over(w)).where(F.col("k") <= length).where("c > 1").select("rep", "n", "v", (F.col("k") <= own).alias("indexed"))


def _estimated(pairs: DataFrame, classes: DataFrame, floor: float, most: int = ESTIMATE) -> DataFrame:
    """Pairs (a, b, w) whose union sketch (the lowest `most` values of both) has at least a share `floor` of values of both."""
    cut = F.slice("sketch", 1, most)
    one = pairs.select("a", "b").join(classes.select(F.col("rep").alias("b"), cut.alias("sb"), F.col("n").alias("nb")), "b")
    two = one.join(classes.select(F.col("rep").alias("a"), cut.alias("sa"), F.col("n").alias("na")), "a")
    union = two.select("a", "b", (F.col("na") + F.col("nb")).alias("w"), "sa", "sb", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, most).alias("su"))
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.col("su")))
    return union.where(shared >= F.lit(floor) * F.size("su")).select("a", "b", "w").distinct()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, shared and total: the sizes of the intersection and the union of both whole sets.

    pairs: a written table of a, b and w, the sum of their sizes. Pairs are dealt to cells of some CELL_WORK shingles. Those of a document
    with more work than a cell's, a hub, are dealt by the other one's hash, to as many cells as the hub's work asks for; all others to the
    cells of a square, by a's and b's hashes. A text goes once to each cell that asks for it, so in a crowd of like texts it is
    sent as often as the square is wide, not as it has partners, and a star's hub is all that is sent to many cells.
    """
    total = pairs.agg(F.sum("w")).first()[0] or 0
    wide = max(1, int((total / CELL_WORK) ** 0.5 + 0.999))
    place = lambda c, n: F.pmod(F.xxhash64(c), n)
    loads = pairs.select(F.explode(F.array("a", "b")).alias("node"), "w").groupBy("node").agg(F.ceil(F.sum("w") / CELL_WORK).alias("parts")).where("parts > 1")
    both = pairs.join(loads.select(F.col("node").alias("a"), F.col("parts").alias("pa")), "a", "left").join(loads.select(F.col("node").alias("b"), F.col("parts").alias("pb")), "b", "left")
    first = F.coalesce("pa", F.lit(0)) >= F.coalesce("pb", F.lit(0))
    star = F.coalesce("pa", "pb").isNotNull()
    x = F.when(~star, place("a", F.lit(wide))).when(first, F.col("a")).otherwise(F.col("b"))
    y = F.when(~star, place("b", F.lit(wide))).when(first, place("b", F.col("pa"))).otherwise(place("a", F.col("pb")))
    asked = both.select("a", "b", star.alias("star"), x.alias("x"), y.alias("y"))
    cell = ["star", "x", "y"]
    wanted = asked.select(*cell, F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    at = ["at_star", "at_x", "at_y"]
    sent = wanted.join(texts.select("doc_id", "text"), "doc_id").select(*[F.col(c).alias(d) for c, d in zip(cell, at, strict=True)], "doc_id", "text")

    def verify(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        sets: dict[int, list[np.ndarray]] = {}
        for batch in tk.chunks(left.select(["doc_id", "text"]).to_batches(), "text"):
            for d, s in zip(batch.column(0).to_pylist(), shingles(batch.column(1)), strict=True):
                sets.setdefault(d, []).append(s)
        out = []
        for a, b in zip(right["a"].to_pylist(), right["b"].to_pylist(), strict=True):
            for x in sets.get(a, ()):
                for y in sets.get(b, ()):  # rows that share a doc_id may differ in text
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    out.append((a, b, shared, len(x) + len(y) - shared))
        return pa.table([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=["a", "b", "shared", "total"])

    return sent.groupBy(*at).cogroup(asked.groupBy(*cell)).applyInArrow(verify, "a long, b long, shared long, total long")


def _is_link() -> Column:
    return LINK[1] * F.col("shared") >= LINK[0] * F.col("total")


def _alike_sizes(n: int, m: np.ndarray) -> np.ndarray:
    return LINK[1] * np.minimum(n, m) >= LINK[0] * np.maximum(n, m)


def _may_link(table: pa.Table, x: np.ndarray, y: np.ndarray, asked: Callable[[int, np.ndarray], np.ndarray]) -> pa.Table:
    """a, b, w: pairs of rows x by rows y that are asked for and whose deep sketches share as much as a link's must.

    Values of y are sorted once; a row of x counts what it shares with all of y by looking its values up.
    """
    rep, n = table["rep"].to_numpy(), table["n"].to_numpy()
    sets = table["sketch"].combine_chunks()
    values, offsets = sets.values.to_numpy(), sets.offsets.to_numpy()
    held = np.concatenate([values[offsets[k] : offsets[k + 1]] for k in y] or [np.empty(0, np.int64)])
    owner = np.repeat(np.arange(len(y)), [offsets[k + 1] - offsets[k] for k in y])
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    out: list[tuple[int, int, int]] = []
    for k in x:
        mine = values[offsets[k] : offsets[k + 1]]
        low, high = np.searchsorted(held, mine, "left"), np.searchsorted(held, mine, "right")
        size = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        shared = np.bincount(owner[at], minlength=len(y))
        whole = (n[k] <= DEEP) & (n[y] <= DEEP)
        # of the larger set a link's smaller one has a share of `part`, so of the larger set's sketch as well, give or take 6 deviations
        part = LINK[0] / (LINK[0] + LINK[1]) * (1 + np.minimum(n[k], n[y]) / np.maximum(n[k], n[y]))
        least = DEEP * part - 6 * np.sqrt(DEEP * part * (1 - part))
        may = np.where(whole, LINK[1] * shared >= LINK[0] * (n[k] + n[y] - shared), shared >= least)
        out += [(min(rep[k], rep[j]), max(rep[k], rep[j]), n[k] + n[j]) for j in y[may & asked(k, y) & (rep[y] != rep[k]) & _alike_sizes(n[k], n[y])]]
    out = sorted(set(out))
    return pa.table([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["a", "b", "w"])


def _within(lists: DataFrame, deep: DataFrame) -> DataFrame:
    """a, b, w: pairs of a list's members, of different components, that may be links.

    Members are dealt to blocks of CROSS_ROWS by hash and a task compares two blocks, so no task grows with a list.
    """
    blocks = F.ceil(F.col("c") / CROSS_ROWS).cast("long")
    rows = lists.select("v", "rep", "comp", "indexed", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).alias("own"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = rows.select("v", F.least("own", "other").alias("bx"), F.greatest("own", "other").alias("by"), "own", "rep", "comp", "indexed")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        n, comp, indexed, own = (table[c].to_numpy() for c in ("n", "comp", "indexed", "own"))
        bx, by = key[1].as_py(), key[2].as_py()
        asked = lambda k, y: (comp[k] != comp[y]) & (n[k] <= n[y])
        sides = ((bx, by), (by, bx)) if bx != by else ((bx, bx),)
        return pa.concat_tables([_may_link(table, np.flatnonzero(indexed.astype(bool) & (own == p)), np.flatnonzero(own == q), asked) for p, q in sides])

    return dealt.join(deep, "rep").groupBy("v", "bx", "by").applyInArrow(compare, "a long, b long, w long").distinct()


def _crossed(sides: DataFrame, deep: DataFrame) -> DataFrame:
    """a, b: pairs of a hub's two sides whose deep sketches share as much as a link's must.

    sides: hub, far (which side), rep, d (distance from the hub), comp. Both sides are dealt to blocks, and a task compares two blocks:
    what is shuffled grows with the sides' product only divided by CROSS_ROWS, and of the pairs only those that may be links are rows.
    """
    sizes = sides.groupBy("hub").agg(F.count_if("far").alias("x"), F.count_if(~F.col("far")).alias("y")).where("x > 0 and y > 0")
    blocks = lambda c: F.ceil(F.col(c) / CROSS_ROWS).cast("long")
    rows = sides.join(sizes, "hub").withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("far"), blocks("x")).otherwise(blocks("y"))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("far"), blocks("y")).otherwise(blocks("x")) - 1)))
    dealt = rows.select("hub", F.when(F.col("far"), F.col("own")).otherwise(F.col("other")).alias("bx"), F.when(F.col("far"), F.col("other")).otherwise(F.col("own")).alias("by"), "far", "rep", "d", "comp")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        far, rep, d, comp = (table[c].to_numpy() for c in ("far", "rep", "d", "comp"))
        far = far.astype(bool)
        return _may_link(table, np.flatnonzero(far), np.flatnonzero(~far), lambda k, y: (comp[k] != comp[y]) & (d[k] - d[y] <= 0.25 + 1e-9))

    return dealt.join(deep, "rep").groupBy("hub", "bx", "by").applyInArrow(compare, "a long, b long, w long").distinct()


def _linked(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    return written(_verified(pairs, texts).where(_is_link()).select("a", "b"), name)


def _hub_links(members: DataFrame, classes: DataFrame, deep: DataFrame, texts: DataFrame, links: DataFrame) -> DataFrame:
    """links, and more: those between classes that only long lists vouch for, without forming a long list's pairs.

    members: v, rep, n, indexed. In a round each list's least indexed class is its hub, and is compared with the list's others. Those linked
    with the hub are joined through it and leave the list, as does the hub. Jaccard distance is a metric, so a class that stays
    can be linked with one that leaves only if its distance from the hub is in (1/4, 1/2]: it is compared with those that
    leave whose distance from the hub is within 1/4 of its own. Classes that are in one component already needn't be
    compared, and a list of one component is done: so a list of near copies of one text is settled in a round. A short list has its
    pairs formed; what a round of hubs leaves of a list is compared block by block if it is no longer than CROSS_ROWS, a limit
    that grows with each round, so that the rounds grow with the logarithm of the longest list. A task never has more than two blocks.
    """
    short, members = SHORT_LIST, members.withColumn("comp", F.col("rep"))
    while True:
        mark = F.xxhash64("rep", "indexed")
        stats = members.groupBy("v").agg(F.bit_xor(mark).alias("m1"), F.bit_xor(F.xxhash64(mark)).alias("m2"), F.count("*").alias("c"), F.count_if("indexed").alias("ci"), F.min(F.when(F.col("indexed"), F.col("rep"))).alias("hub"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2 and ci > 0")
        # of lists with the same members, as the words of one passage make, one is enough
        stats = stats.groupBy("m1", "m2", "c", "ci", "hub").agg(F.min("v").alias("v")).drop("m1", "m2")
        counted = written(members.join(stats, "v"), "members")
        if short == SHORT_LIST:
            may, is_long = _estimated(_short_pairs(counted), classes, FLOOR), F.col("c") * F.col("ci") > short * short
        else:
            may, is_long = _within(counted.where(F.col("c") <= short), deep), F.col("c") > short
        links = links.unionByName(_linked(written(may, "short"), texts, "links"))
        long_ = counted.where(is_long)
        if long_.isEmpty():
            return links
        hubs = long_.where("rep <> hub").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()
        judged = written(_verified(written(_estimated(hubs, deep, HUB_FLOOR, DEEP), "hubs"), texts), "judged")
        links = links.unionByName(judged.where(_is_link()).select("a", "b"))
        roots = components.roots(links).select(F.col("node").alias("rep"), F.col("root").alias("known"))
        found = judged.withColumn("d", 1 - F.col("shared") / F.col("total")).withColumn("linked", _is_link())
        distance = found.select(F.col("a").alias("hub"), F.col("b").alias("rep"), "d", "linked").unionByName(found.select(F.col("b").alias("hub"), F.col("a").alias("rep"), "d", "linked"))
        at = long_.where("rep <> hub").drop("comp").join(distance, ["hub", "rep"], "left").join(roots, "rep", "left")
        at = written(at.withColumn("linked", F.coalesce("linked", F.lit(False))).withColumn("comp", F.coalesce("known", "rep")), "distances")
        sides = at.where("linked or d <= 0.5").select("hub", (~F.col("linked")).alias("far"), "rep", "d", "comp").distinct()
        links = links.unionByName(_linked(written(_crossed(sides, deep), "cross"), texts, "links"))
        members = at.where("not linked").select("v", "rep", "n", "comp", "indexed")
        short = CROSS_ROWS if short == SHORT_LIST else short * PATIENCE


def clusters(docs: DataFrame) -> DataFrame:
    """What _clusters() says, as a table of its own: the sketches, lists and links that led to it are deleted."""
    with scratch(docs.sparkSession):
        return written(_clusters(docs), "clusters", keep=True)


def _clusters(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row.

    Rows of equal sets are one class, known by its least doc_id. Sketches of classes are inverted: classes that share a value of a
    short list are paired; classes with too few such values are compared among themselves, by the rarest values of a deeper
    sketch and by hubs of lists that are long even so. Union sketches drop what is far from a link, whole sets settle the rest, and components
    join links. Every link is found but for sketches that share too little by chance: at the limit of 0.75 a link is lost with a
    probability under 2e-8 (the estimate's floor 4.2e-9, the missed short lists 3.4e-9, the deep sketches 3.1e-9, their prefixes as much,
    and 4.2e-10 for each hub's floor). Very long texts are hashed whole, a text at a time; ties of hash values are ordered by the value. Empty and null
    texts have no set and are linked with nothing, and so are rows without a doc_id (their component is null). Equal texts are
    linked, of any number. Other columns of docs are left aside, repeated rows get a row each, an empty table gives an empty one.
    """
    rows = written(sketched(docs), "sketches")
    known = rows.where("n > 0 and doc_id is not null")
    classes = written(known.groupBy("mark").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    lists = _lists(classes.select("rep", "n", F.explode(F.slice("sketch", 1, INVERTED)).alias("v")), "lists")
    pairs = written(_estimated(_short_pairs(lists), classes, FLOOR), "pairs")
    unsafe = written(_unsafe(classes, lists), "unsafe")
    # ids grow with the documents, so their join with texts is a merge at every size
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(unsafe.select(F.col("rep").alias("doc_id")))
    texts = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(needed.distinct().hint("merge"), "doc_id", "left_semi"), "texts")
    links = _linked(pairs, texts, "links")
    if not unsafe.isEmpty():
        deep = _deep(unsafe, texts)
        links = _hub_links(_prefixes(deep), classes, deep, texts, links)
    roots = components.roots(links)
    named = classes.select("mark", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("mark", F.coalesce("root", "rep").alias("component"))
    placed = rows.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("mark")).alias("mark")).join(named, "mark", "left")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    """clusters() and kept: true for the document that stands for its component."""
    return clusters(docs).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs' rows, with docs' own columns, of the documents that stand for their components.

    Rows that share a doc_id stay or go together; rows without one stay.
    """
    gone = clusters(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("d")).distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    return own.join(gone, F.col("own.doc_id") == F.col("d"), "left_anti").select("own.*")
