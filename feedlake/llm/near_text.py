"""Near-duplicate texts: MinHash signatures in an LSH forest, links confirmed on full shingle sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.llm.components import components
from feedlake.llm.grouping import grouped, tile_roots
from feedlake.llm.scratch import discard, salted_join, stash, table
from feedlake.llm.shingles import MinHasher, WordHashes, set_key, shingle_set

#: Sorted orders (trees), and values of a signature that two classes must share at the head of an order.
TREES, DEPTH = 16, 4
VALUES = TREES * DEPTH
#: Rows before its own with which each row of a sorted order is compared.
NEIGHBOURS = 3
#: A region with more members is compared in blocks of about so many, each pair of blocks, so that no pair is given up.
REGION = 1024
#: Members of a block in the final comparison.
BLOCK = 256


def describe(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, set_key, sig, sketch) of every row; sig holds the MinHash values as little-endian uint32,
    sketch the lowest byte of each."""

    def each(batches):
        words, hasher = WordHashes(), MinHasher(VALUES)
        for batch in batches:
            n, keys, sigs, sketches = [], [], [], []
            for text in batch["text"]:
                values = shingle_set(text, width, words)
                n.append(len(values))
                keys.append(set_key(values) if len(values) else None)
                sig = hasher(values) if len(values) else None
                sigs.append(None if sig is None else sig.tobytes())
                sketches.append(None if sig is None else sig.astype(np.uint8).tobytes())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": n, "set_key": keys, "sig": sigs, "sketch": sketches})

    # ids travel as text: pandas would turn a batch with a null among them into floats
    slim = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    made = slim.mapInPandas(each, "doc_id string, n_shingles long, set_key binary, sig binary, sketch binary")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def _orders() -> Column:
    """Of a class, for each tree: its number, the values at the head of its order, and the low bytes of all values in its
    order, which sort what shares the head and tell how many values two classes share (a chance match in 256)."""
    head = lambda t: F.substring("sig", 4 * t * DEPTH + 1, 4 * DEPTH)
    tail = lambda t: F.concat(F.substring("sketch", t * DEPTH + 1, VALUES), F.substring("sketch", 1, t * DEPTH)) if t else F.col("sketch")
    return F.explode(F.array(*[F.struct(F.lit(t).cast("byte").alias("tree"), head(t).alias("head"), tail(t).alias("order")) for t in range(TREES)])).alias("o")


def _sketches(rows: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), VALUES)


def _neighbours(classes: DataFrame, least: int) -> DataFrame:
    """(a, b) with a < b: of each tree's sorted order, the rows next to each other that share the head and `least` values.

    The longest common prefixes of a sorted order are those of neighbours, so each class meets those with which it
    shares the deepest region, however deep that is. One range sort of all orders, one linear pass; the few neighbours
    on either side of a partition's border don't meet here.
    """

    def each(batches):
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            new = len(rows) - len(batch)
            rep, sketch = rows["rep"].to_numpy(), _sketches(rows["order"])
            tree, head = rows["tree"].to_numpy(), np.frombuffer(b"".join(rows["head"]), np.uint32).reshape(len(rows), DEPTH)
            for d in range(1, NEIGHBOURS + 1):
                at = np.arange(max(d, new), len(rows))
                at = at[(tree[at] == tree[at - d]) & (head[at] == head[at - d]).all(axis=1)]
                near = at[(sketch[at] == sketch[at - d]).sum(axis=1) >= least]
                if len(near):
                    yield pd.DataFrame({"a": np.minimum(rep[near], rep[near - d]), "b": np.maximum(rep[near], rep[near - d])})
            held = rows.iloc[-NEIGHBOURS:]

    key = ["tree", "head", "order", "rep"]
    rows = classes.select("rep", _orders()).select("o.tree", "o.head", "o.order", "rep")
    dealt = rows.repartitionByRange(*key).sortWithinPartitions(*key)  # its cost goes by bytes, so adaptive execution may merge
    return dealt.mapInPandas(each, "a long, b long").distinct()


def _deal(rows: DataFrame, group: str, limit: int) -> DataFrame:
    """rows (with `group`, rep and part) dealt into tiles (group, ba, bb, own) so that any two rows of one group and of
    different parts meet in a tile. Groups of one part are left out; one with at most `limit` rows is a single tile.

    In a larger group the rows of its largest part have blocks of their own, and two of these need no tile. Plans are
    one row a group; they join with a salt, so that a hot group's rows are not dealt by one task.
    """
    parts = rows.groupBy(group, "part").agg(F.count("*").alias("n"))
    plan = parts.groupBy(group).agg(F.max_by("part", F.struct("n", -F.col("part"))).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all"), F.count("*").alias("parts")).where("parts > 1")
    whole = F.col("n_all") <= limit
    others = F.when(whole, 1).otherwise(F.ceil((F.col("n_all") - F.col("n_main")) / limit)).cast("int")
    plan = plan.select(group, "main", others.alias("others"), F.when(whole, 0).otherwise(F.ceil(F.col("n_main") / limit)).cast("int").alias("main_blocks"))
    in_main = (F.col("part") == F.col("main")) & (F.col("main_blocks") > 0)
    at = F.xxhash64(F.lit("block"), "rep")
    own = F.when(in_main, F.col("others") + F.pmod(at, F.greatest("main_blocks", F.lit(1)))).otherwise(F.pmod(at, F.col("others"))).cast("int")
    last = F.when(in_main, F.col("others")).otherwise(F.col("others") + F.col("main_blocks")) - 1
    dealt = salted_join(rows, plan, [group], "rep").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return dealt.withColumn("ba", F.least("own", "other")).withColumn("bb", F.greatest("own", "other")).drop("other", "main", "others", "main_blocks")


def _bridges(classes: DataFrame, reached: DataFrame, least: int, limit: int) -> DataFrame:
    """(a, b): what the neighbours left apart. Of each region (the classes that share a head) whose members lie in
    different components of `reached`, a spanning forest of the pairs of different components that agree most."""
    parts = reached.select(F.col("node").alias("rep"), "component")
    placed = classes.select("rep", "sig", "sketch").join(parts, "rep", "left").select("rep", F.coalesce("component", "rep").alias("part"), _orders()).select(
        "rep", "part", F.xxhash64("o.tree", "o.head").alias("region"), F.col("o.order").alias("order"))
    # written first, so that its size is known when the plan of the join is made
    open_ = stash(placed.groupBy("region").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("region"), "regions")
    members = stash(salted_join(placed, open_, ["region"], "rep"), "regions")

    def each(batches):
        for group in grouped(batches, ["region", "ba", "bb"]):
            group = group.sort_values("rep", kind="stable")
            reps = group["rep"].to_numpy()
            pairs = np.array(_strongest_tree(_sketches(group["order"]), group["part"].to_numpy(), least), int).reshape(-1, 2)
            if len(pairs):
                x, y = reps[pairs[:, 0]], reps[pairs[:, 1]]
                yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    dealt = _deal(members, "region", limit).select("region", "ba", "bb", "rep", "part", "order")
    tiles = dealt.repartition("region", "ba", "bb").sortWithinPartitions("region", "ba", "bb")
    found = stash(tiles.mapInPandas(each, "a long, b long"), "pairs")
    discard(open_)
    discard(members)
    return found


def _agreement(sigs: np.ndarray, row: np.ndarray) -> np.ndarray:
    return (sigs == row).sum(axis=1)


def _strongest_tree(sigs: np.ndarray, part: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Pairs of a spanning forest of the members that agree most (Prim): none below `least` equal values, and none within
    a part, whose members count as joined."""
    n = len(sigs)
    best, parent = np.full(n, -1), np.full(n, -1)
    open_ = np.ones(n, bool)
    pairs = []
    for _ in range(n):
        at = int(np.argmax(np.where(open_, best, -2)))
        open_[at] = False
        if parent[at] >= 0 and least <= best[at] <= VALUES:
            pairs.append((int(parent[at]), at))
        same = np.where(part == part[at], VALUES + 1, _agreement(sigs, sigs[at]))
        better = open_ & (same > best)
        best[better], parent[better] = same[better], at
    return pairs


def _sets(pairs: DataFrame, texts: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(rep, items): the full shingle sets of the classes in pairs, made from their texts again."""
    ids = pairs.select(F.col("a").alias("rep")).unionAll(pairs.select(F.col("b").alias("rep")))
    wanted = classes.select("rep", "set_key").join(ids, "rep", "left_semi")

    def each(batches):
        words = WordHashes()
        for batch in batches:
            sets = [shingle_set(text, width, words) for text in batch["text"]]
            same = [len(x) > 0 and set_key(x) == key for x, key in zip(sets, batch["set_key"], strict=True)]  # a doc_id may have several texts
            yield pd.DataFrame({"rep": batch["rep"][same], "items": [x.view(np.int64) for x, ok in zip(sets, same, strict=True) if ok]})

    return texts.join(wanted, "rep").mapInPandas(each, "rep long, items array<long>").dropDuplicates(["rep"])


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs whose full shingle sets are similar enough: num / den <= intersection / union, in integers."""
    num, den = threshold
    right = sets.select(F.col("rep").alias("b"), F.col("items").alias("items_b"))
    left = sets.select(F.col("rep").alias("a"), F.col("items").alias("items_a"))
    shared = F.size(F.array_intersect("items_a", "items_b")).cast("long")
    total = (F.size("items_a") + F.size("items_b")).cast("long")
    both = pairs.join(right, "b").join(left, "a").select("a", "b", shared.alias("i"), total.alias("t"))
    return both.where(F.col("i") * den >= (F.col("t") - F.col("i")) * num).select("a", "b")


def _intersections(items_a: list, items_b: list) -> np.ndarray:
    """Sizes of the intersections of every set of one list with every set of the other: incidence matrices, a few
    thousand columns at a time."""
    every = np.concatenate([*items_a, *items_b])
    row = np.repeat(np.arange(len(items_a) + len(items_b)), [len(x) for x in (*items_a, *items_b)])
    _, where, count = np.unique(every, return_inverse=True, return_counts=True)
    use = count[where] > 1
    row, where = row[use], where[use]
    order = np.argsort(where, kind="stable")
    row, where = row[order], where[order]
    new = np.concatenate([[0], np.cumsum(where[1:] != where[:-1])]) if len(where) else where
    out = np.zeros((len(items_a), len(items_b)), np.int64)
    for at in range(0, int(new[-1]) + 1 if len(new) else 0, 4096):
        lo, hi = np.searchsorted(new, [at, at + 4096])
        m = np.zeros((len(items_a) + len(items_b), 4096), np.float32)
        m[row[lo:hi], new[lo:hi] - at] = 1
        out += np.rint(m[: len(items_a)] @ m[len(items_a) :].T).astype(np.int64)
    return out


def _cross_links(group: pd.DataFrame, least: int, threshold: tuple[int, int]) -> pd.DataFrame | None:
    """Links between the members of two blocks that lie in different components, as a spanning forest."""
    num, den = threshold
    group = group.sort_values("rep", kind="stable")
    ba, bb, own = group["ba"].iat[0], group["bb"].iat[0], group["own"].to_numpy()
    a, b = np.flatnonzero(own == ba), np.flatnonzero(own == bb)
    reps, part = group["rep"].to_numpy(), group["part"].to_numpy()
    sigs = _sketches(group["sketch"])
    want = np.array([_agreement(sigs[b], sigs[i]) >= least for i in a]).reshape(len(a), len(b)) & (part[a][:, None] != part[b][None, :])
    rows, cols = np.flatnonzero(want.any(axis=1)), np.flatnonzero(want.any(axis=0))
    if not len(rows):
        return None
    a, b, want = a[rows], b[cols], want[np.ix_(rows, cols)]
    items = group["items"].to_list()
    n = np.array([len(x) for x in items])
    shared = _intersections([items[i] for i in a], [items[i] for i in b])
    links = want & (shared * den >= (n[a][:, None] + n[b][None, :] - shared) * num)
    if not links.any():
        return None
    root_a, root_b = tile_roots(links, reps[a], reps[b])
    out = pd.DataFrame({"a": np.concatenate([root_a, root_b]), "b": np.concatenate([reps[a], reps[b]])})
    return out[out["a"] != out["b"]]


def _rest(reached: DataFrame, found: DataFrame, classes: DataFrame, sets: DataFrame, least: int, threshold: tuple[int, int], block: int) -> DataFrame:
    """(a, b): links that the proposals did not show.

    The proposals span everything that may be linked, so all links lie within the proposals' own components
    (`reached`). Where such a wide component holds several confirmed ones, all pairs of its members in different
    confirmed components are compared on full sets, in tiles of two blocks; two blocks of its largest confirmed
    component need no tile. Of each tile's links only a spanning forest leaves it.
    """
    placed = reached.select(F.col("node").alias("rep"), F.col("component").alias("wide")).join(found.select(F.col("node").alias("rep"), F.col("component").alias("part")), "rep", "left").withColumn("part", F.coalesce("part", "rep"))
    placed = stash(placed, "placed")
    dealt = _deal(placed, "wide", block)
    full = dealt.join(classes.select("rep", "sketch"), "rep").join(sets, "rep")

    def each(batches):
        for group in grouped(batches, ["wide", "ba", "bb"]):
            links = _cross_links(group, least, threshold)
            if links is not None:
                yield links

    tiles = full.repartition("wide", "ba", "bb").sortWithinPartitions("wide", "ba", "bb")
    more = stash(tiles.mapInPandas(each, "a long, b long"), "links")
    discard(placed)
    return more


def near_duplicates(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text", region: int = REGION, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a text's set holds its runs of `width` words. Two texts are
    linked when their sets' Jaccard similarity is at least threshold[0] / threshold[1]; component_id is the smallest
    doc_id that links reach.

    Method (LSH forest): texts with equal sets form one class. Each class has 64 MinHash values; each of 16 trees
    sorts the classes by its own order of these values. Neighbours in a sorted order have the longest common prefixes;
    those that share at least 4 values at its head are candidates, so a region is searched as deep as its members
    reach. Then the search climbs: where the classes that share 4 values lie in different components of the candidates,
    the pairs of different components that agree most are candidates too (a region with more than `region` members is
    compared block by block). Candidates are confirmed on full sets; then, within what they span, every pair that agrees
    enough but still lies in different components is confirmed as well, in tiles that no pair leaves. A pair at
    similarity 0.85 is missed by all trees with a chance of 7e-6, however large its regions are; the work on a region grows
    with the square of its size only where it holds many components.

    Nulls: a null or empty text, or one of white space only, has n_shingles 0, is its own component and is kept. A
    row whose doc_id is null links with nothing and gets component_id null and kept false. Repeated rows appear as
    often as they occur. Other columns of docs are ignored. An empty table gives an empty table.
    """
    num, den = threshold
    share = num / den
    least = max(1, int(np.floor(VALUES * share - 4.5 * np.sqrt(VALUES * share * (1 - share)))))
    rows = stash(describe(docs, width, id_col, text_col), "signatures")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    classes = stash(classes, "classes")
    tried = stash(_neighbours(classes, least), "pairs")
    reached = components(tried, "a", "b")
    bridges = _bridges(classes, reached, least, region)
    if not bridges.isEmpty():
        before, tried = tried, stash(tried.unionByName(bridges), "pairs")
        discard(before)
        discard(reached)
        reached = components(tried, "a", "b")
    discard(bridges)
    sets = stash(_sets(tried, texts, classes, width), "sets")
    links = stash(_confirmed(tried, sets, threshold), "links")
    found = components(links, "a", "b")
    more = _rest(reached, found, classes, sets, least, threshold, block)
    if not more.isEmpty():
        before, found = found, components(links.unionByName(more), "a", "b")
        discard(before)
    for used in (tried, reached, sets, links, more):
        discard(used)
    of_set = classes.select("set_key", "rep").join(found, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("of_set"))
    out = rows.select("doc_id", "n_shingles", "set_key").join(of_set, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_set", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
    out = stash(out, "near")
    for used in (rows, classes, found):
        discard(used)
    return out


def op4_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of whole documents: 3-word shingles, similarity 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, threshold=(85, 100))
