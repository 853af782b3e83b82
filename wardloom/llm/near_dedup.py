"""MinHash near-dedup by chosen-path set similarity join.

Texts with the same set of five-word shingles are one class, so copies are
never compared.  For the classes, several independent trees are grown: a tree
puts each class under one of its minwise tokens, and nodes that stay large are
branched again by further tokens.  Classes are then compared inside nodes:

1. with a few pivots of each root node.  Links confirmed on full sets give a
   first set of components, after which most nodes hold one component only and
   are done (a group of thousands of near copies is settled here, in linear
   work);
2. in the rest, all members are compared with those outside the node's largest
   component, if that is little work.  Other nodes branch; one that branching
   doesn't halve (its members are all fairly alike, though many may not link),
   or whose alike pairs outnumber its members DENSE times, is compared on full
   sets, in blocks of bounded size that report a spanning forest of their links.

A comparison is first a sketch of 128 bytes (one per minwise hash), in
generated code or numpy; pairs that may reach the threshold are confirmed on the full
sets, recomputed from the texts.  Two texts at the threshold share a given
minwise token three times in four, so TREES = 12 trees miss one root node in
4 ** 12, and the sketch's limit lies 4.5 standard deviations down.

Defined results: null text is empty; empty texts have no shingles and link with
nothing, copies of them neither; texts of under five words have their whole
sequence as one shingle; a long text's whole set counts (a task holds one such
set, of eight bytes a word, at a time, two where a pair is confirmed); repeated
rows are copies of each other; ids must be whole numbers (they are cast to
long); a row with a null id takes its group's component, is its own (null) one
otherwise and isn't kept in a group that has an id; an empty table gives no
rows; other columns are not read, so they can't clash (``keep_one`` replaces
``__id`` and ``__th``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.llm.common import stored, table, text_of

SHINGLE = 5
PERCENT = 75
TREES = 12
SKETCH = 128
WORDS = SKETCH // 8
#: 128 * 0.75, less 4.5 standard deviations of the count of equal hashes there.
ALIKE = 74
PIVOTS = 4
#: Comparisons that a node may need before it is branched instead.
WORK = 20_000
#: Alike pairs for each member of a node that are reported one by one.
DENSE = 4
#: Comparisons of sketches that a task makes at a time (of 128 bytes each).
AT_ONCE = 1 << 17
MAX_DEPTH = 6
BRANCHES = 2
#: A node's members meet what is known of the node in so many tasks.
SALTS = 16
#: Hashed tokens in a chunk of a large node; a block holds two chunks.
BLOCK_BYTES = 8 << 20
_NO_ID = -(1 << 63)
_S = [f"s{i}" for i in range(WORDS)]


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z and the six ASCII spaces alone
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(SHINGLE, len(h))
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += h[i : len(h) - n + 1 + i]
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def minwise(tokens: np.ndarray) -> np.ndarray:
    """TREES + SKETCH minwise hashes of a set of hashed tokens."""
    rng = np.random.default_rng(20)
    times = rng.integers(1, 1 << 63, TREES + SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.full(TREES + SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(tokens), 512):
        h = tokens[k : k + 512, None] * times
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        np.minimum(out, h.min(axis=0), out=out)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, set_key (null: empty), roots (a node in each tree), s0 .. s15."""
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).withColumn("th", F.xxhash64("text"))
    schema = "doc_id long, th long, n_shingles long, set_key binary, roots array<long>, " + ", ".join(f"{s} long" for s in _S)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sizes, keys, roots, sketches = [], [], [], []
            for t in batch.column("text"):
                tokens = shingle_set(t.as_py())
                sizes.append(len(tokens))
                keys.append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
                m = minwise(tokens) ^ np.concatenate([np.arange(TREES, dtype=np.uint64) << np.uint64(58), np.zeros(SKETCH, np.uint64)])
                roots.append(m[:TREES].view(np.int64))
                sketches.append((m[TREES:] >> np.uint64(40)).astype(np.uint8).view(np.int64))
            s = np.stack(sketches) if sketches else np.empty((0, WORDS), np.int64)
            columns = [pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(roots, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), *columns, *(pa.array(s[:, i]) for i in range(WORDS))],
                names=["doc_id", "th", "n_shingles", "set_key", "roots", *_S],
            )

    return rows.mapInArrow(run, schema)


def alike(a: str, b: str) -> Column:
    """How many of the sketches' bytes are equal; a and b are prefixes of the sketch columns."""
    differ = F.lit(0)
    for s in _S:
        x = F.col(a + s).bitwiseXOR(F.col(b + s))
        for n in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, n))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return F.lit(SKETCH) - differ


def _prefixed(df: DataFrame, prefix: str, *more: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in ("cid", *_S, *more)))


def texts_of(cids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(cid, text) of the classes named."""
    of = cids.distinct().join(classes.select("cid", "id", "th"), "cid")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), text_of().alias("text")).withColumn("th", F.xxhash64("text"))
    return stored(texts.join(of, ["id", "th"]).select("cid", "text").dropDuplicates(["cid"]), "near-texts")


def confirmed(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) of classes whose full sets, from the texts ``found``, reach the threshold."""
    of = lambda side: found.select(F.col("cid").alias(side), F.col("text").alias(f"text_{side}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ok = []
            for x, ta, tb in zip(a, batch.column("text_a"), batch.column("text_b"), strict=True):
                if x != held:
                    held, tokens = x, shingle_set(ta.as_py())
                other = shingle_set(tb.as_py())
                n = len(np.intersect1d(tokens, other, assume_unique=True))
                ok.append(100 * n >= PERCENT * (len(tokens) + len(other) - n))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(cid, comp): the smallest node that each linked node reaches.

    Alternates large-star and small-star steps over the edge table until it
    no longer changes; every step is a minimum by node and a join.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        before = edges
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ways.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        edges = ways.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        two = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        edges = edges.join(low, "u").select(F.explode(two).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = stored(edges, "edges")
        if edges.count() == before.count() and edges.join(before, ["u", "v"], "left_anti").isEmpty():  # both are distinct
            return edges.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "cid")


def _with_comp(classes: DataFrame, comp: DataFrame) -> DataFrame:
    return classes.join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))


def _join_nodes(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members (node, cid, ...) with what is known of their node (a row each), however large one node is."""
    salted = members.withColumn("__salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)))
    every = nodes.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(every, ["node", "__salt"]).drop("__salt")


def pivot_pairs(roots: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of root nodes with their node's pivots, if their sketches are alike enough."""
    picks = [F.min_by("cid", F.xxhash64("cid", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)]
    pivots = F.array_distinct(F.array(*(f"p{k}" for k in range(PIVOTS))))
    chosen = roots.groupBy("node").agg(F.count("*").alias("n"), *picks).filter("n > 1").select("node", pivots.alias("p"))
    pairs = _join_nodes(roots, chosen).select("cid", F.explode("p").alias("p")).filter("cid <> p")
    pairs = pairs.select(F.least("cid", "p").alias("a"), F.greatest("cid", "p").alias("b")).distinct()
    with_a = pairs.join(_prefixed(classes, "a_"), F.col("a") == F.col("a_cid"))
    near = with_a.join(_prefixed(classes, "b_"), (F.col("b") == F.col("b_cid")) & (alike("a_", "b_") >= ALIKE))
    return near.select("a", "b")


def node_pairs(ready: DataFrame, root: bool) -> DataFrame:
    """Members of small nodes compared by sketch, a node at a time: (node, a, b, comp, major).

    A row with b is a pair of classes in different components whose sketches are
    alike enough.  A node with over DENSE such pairs for each of its members
    gives its members instead: a, with comp and major, and no b.  Left out are
    pairs that met in a root node, of an earlier tree where these are root
    nodes, whose members are all compared (bits of ``done``).

    A node here has WORK members at most, so a task holds the rows of one node and one batch.
    """

    def compared(t: pa.Table) -> pa.RecordBatch:
        node, cid, comp, major, tree, done = (t.column(c).to_numpy() for c in ("node", "cid", "comp", "major", "tree", "done"))
        sketch = np.stack([t.column(s).to_numpy() for s in _S], axis=1).view(np.uint8)
        roots = pa.concat_arrays([c.flatten() for c in t.column("roots").chunks]).to_numpy().reshape(-1, TREES)
        _, first, of, size = np.unique(node, return_index=True, return_inverse=True, return_counts=True)
        asks = np.nonzero(comp != major)[0]
        ends = np.cumsum(size[of[asks]])
        cuts = np.unique(np.searchsorted(ends, np.arange(0, (ends[-1] if len(ends) else 0) + AT_ONCE, AT_ONCE)))
        found = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            n = size[of[asks[lo:hi]]]
            i = np.repeat(asks[lo:hi], n)
            j = first[of[i]] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            once = (comp[i] != comp[j]) & ((comp[j] == major[j]) | (cid[i] < cid[j]))
            i, j = i[once], j[once]
            near = (sketch[i] == sketch[j]).sum(axis=1) >= ALIKE
            i, j = i[near], j[near]
            before = done[i] & ((1 << (tree[i].astype(np.int64) if root else TREES)) - 1)
            met = ((roots[i] == roots[j]) & ((before[:, None] >> np.arange(TREES)) & 1 == 1)).any(axis=1)
            found.append(np.stack([i[~met], j[~met]]))
        i, j = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        dense = np.bincount(of[i], minlength=len(size)) > DENSE * size
        one = ~dense[of[i]]
        i, j, members = i[one], j[one], np.nonzero(dense[of])[0]
        none = pa.nulls(len(i), pa.int64())
        columns = [
            np.concatenate([node[i], node[members]]),
            np.concatenate([np.minimum(cid[i], cid[j]), cid[members]]),
            pa.concat_arrays([pa.array(np.maximum(cid[i], cid[j]), pa.int64()), pa.nulls(len(members), pa.int64())]),
            pa.concat_arrays([none, pa.array(comp[members], pa.int64())]),
            pa.concat_arrays([none, pa.array(major[members], pa.int64())]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["node", "a", "b", "comp", "major"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
                last = int(np.searchsorted(rows.column("node").to_numpy(), rows.column("node")[-1].as_py()))
                if last:  # the last node may go on in the next batch
                    yield compared(rows.slice(0, last))
                rest = rows.slice(last)
        if rest is not None:
            yield compared(rest)

    rows = ready.select("node", "cid", "comp", "major", "tree", "done", "roots", *_S)
    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, "node long, a long, b long, comp long, major long")


def path_pairs(roots: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the trees' nodes leave to compare, of classes in different components.

    Returns pairs (a, b) whose sketches are alike enough, from nodes with
    little work and few such pairs; and the members (node, cid, comp, major) of
    nodes with many, and of large nodes that branching doesn't take apart.  A
    pair that meets in several root nodes is reported by the first.
    """

    def byte(c: Column) -> Column:
        """Byte ``c`` of the sketch."""
        word = F.get(F.array(*_S), (c / 8).cast("int"))
        return F.call_function("shiftrightunsigned", word, ((c % 8) * 8).cast("int")).bitwiseAND(F.lit(255))

    fields = ["cid", "comp", "roots", *_S]
    level = roots.join(classes.select(*fields), "cid").select("node", "tree", F.lit(None).cast("long").alias("parent"), *fields)
    pairs = stuck = done = None
    for depth in range(MAX_DEPTH + 1):
        by_comp = level.groupBy("node", "comp").agg(F.count("*").alias("k"), F.max("parent").alias("parent"))
        nodes = by_comp.groupBy("node").agg(
            F.sum("k").alias("n"),
            F.max("k").alias("most"),
            F.max_by("comp", F.struct("k", "comp")).alias("major"),
            F.count("*").alias("comps"),
            F.max("parent").alias("parent"),
        )
        small = (F.col("n") - F.col("most")) * F.col("n") <= WORK
        whole = F.lit(depth == MAX_DEPTH) | (F.coalesce(2 * F.col("n") > F.col("parent"), F.lit(False)))
        nodes = nodes.filter("comps > 1").withColumn("kind", F.when(small, 0).when(whole, 1).otherwise(2))
        level = stored(_join_nodes(level.drop("parent"), nodes.select("node", "n", "major", "kind")), "nodes")
        ready = level.filter("kind = 0")
        if depth == 0:
            done = stored(ready.groupBy("cid").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("tree"))).alias("done")), "done")
        ready = ready.join(done, "cid", "left").withColumn("done", F.coalesce("done", F.lit(0)))
        met = stored(node_pairs(ready, depth == 0), "node-pairs")
        new = met.filter("b IS NOT NULL").select("a", "b")
        pairs = new if pairs is None else pairs.unionByName(new)
        dense = met.filter("b IS NULL").select("node", F.col("a").alias("cid"), "comp", "major")
        kept = level.filter("kind = 1").select("node", "cid", "comp", "major").unionByName(dense)
        stuck = kept if stuck is None else stuck.unionByName(kept)
        rest = level.filter("kind = 2")
        if depth == MAX_DEPTH or rest.isEmpty():
            break
        branch = F.explode(F.array(*(F.pmod(F.xxhash64("node", F.lit(depth * BRANCHES + k)), F.lit(SKETCH)) for k in range(BRANCHES)))).alias("c")
        level = rest.select("node", "tree", F.col("n").alias("parent"), *fields, branch)
        level = level.withColumn("node", F.xxhash64("node", "c", byte(F.col("c")))).select("node", "tree", "parent", *fields)
    return pairs.distinct(), stuck.distinct()


def token_sets(texts: DataFrame) -> DataFrame:
    """(cid, tokens, n): each text's set as the bytes of its sorted hashes, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column("text")]
            columns = [batch.column("cid"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["cid", "tokens", "n"])

    return texts.select("cid", "text").mapInArrow(run, "cid long, tokens binary, n long")


def block_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) inside large nodes, found on full sets, block by block.

    ``members`` (node, cid, comp, major) fall into chunks of about BLOCK_BYTES
    of hashed tokens, those outside the major component, which ask, into chunks
    of their own besides.  A block holds a chunk of askers and a chunk of all,
    counts shared tokens through an inverted index, and reports links that
    unite components not yet united within the block: fewer than it has members.
    So a member moves once for each chunk of askers: once, if few ask.
    """
    sets = stored(token_sets(texts.join(members.select("cid").distinct(), "cid", "left_semi")), "near-sets")
    rows = members.join(sets, "cid").withColumn("asks", F.col("comp") != F.col("major"))
    size = 8 * F.col("n") + 64
    chunks = lambda c: F.greatest(F.lit(1), F.ceil(F.coalesce(c, F.lit(0)) / BLOCK_BYTES)).cast("int")
    sizes = rows.groupBy("node").agg(
        chunks(F.sum(size)).alias("chunks"), chunks(F.sum(F.when(F.col("asks"), size))).alias("ask_chunks"), F.max("asks").alias("any")
    )
    rows = _join_nodes(rows, sizes.filter("any").drop("any"))
    dealt = lambda n, seed: F.pmod(F.xxhash64("cid", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["cid", "comp", "tokens"]
    right = rows.select("node", dealt("chunks", 1).alias("j"), every("ask_chunks").alias("i"), F.lit(False).alias("asks"), *kept)
    left = rows.filter("asks").select("node", every("chunks").alias("j"), dealt("ask_chunks", 2).alias("i"), F.lit(True).alias("asks"), *kept)

    def run(block: pa.Table) -> pa.Table:
        asks = np.array(block.column("asks").to_pylist(), bool)
        cid, comp = block.column("cid").to_numpy(), block.column("comp").to_numpy()
        sets = [np.frombuffer(t.as_py(), np.uint64) for t in block.column("tokens")]
        size = np.array([len(s) for s in sets], np.int64)
        hold = np.nonzero(~asks)[0]
        tokens, at = np.unique(np.concatenate([sets[i] for i in hold] or [np.empty(0, np.uint64)]), return_inverse=True)
        owner = np.repeat(np.arange(len(hold)), size[hold])[np.argsort(at, kind="stable")]
        first = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(tokens)))])
        a, b, up = [], [], {}

        def top(c: int) -> int:
            while (above := up.get(c, c)) != c:
                up[c] = up.get(above, above)
                c = above
            return c

        for i in np.nonzero(asks)[0]:
            k = np.searchsorted(tokens, sets[i])
            k = k[(k < len(tokens)) & (tokens[np.minimum(k, len(tokens) - 1)] == sets[i])] if len(tokens) else k[:0]
            if len(k):
                n = np.bincount(np.concatenate([owner[first[x] : first[x + 1]] for x in k]), minlength=len(hold))
                near = hold[100 * n >= PERCENT * (size[i] + size[hold] - n)]
                near = near[comp[near] != comp[i]]
                for x in near[np.unique(comp[near], return_index=True)[1]]:
                    here, there = top(comp[i]), top(comp[x])
                    if here != there:
                        up[here] = there
                        a.append(min(cid[i], cid[x]))
                        b.append(max(cid[i], cid[x]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    blocks = left.unionByName(right.select(*left.columns))
    return blocks.groupBy("node", "i", "j").applyInArrow(run, "a long, b long")


def near_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id, component_id and kept."""
    return _components_of(docs).drop("th", "comp")


def _components_of(docs: DataFrame) -> DataFrame:
    """``near_components`` with th (hash of the text) and comp (a number of the component, null without shingles)."""
    rows = stored(signatures(docs).withColumn("uid", F.monotonically_increasing_id()), "signatures")
    firsts = rows.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.min("uid").alias("cid"), F.min("doc_id").alias("class_id"))
    firsts = stored(firsts, "classes")
    one = rows.join(firsts.select("cid", "class_id"), F.col("uid") == F.col("cid"))
    classes = stored(one.select("cid", "class_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "th", "roots", *_S), "class-sketches")
    roots = classes.select("cid", F.posexplode("roots").alias("tree", "node"))
    ends = lambda pairs: pairs.select(F.col("a").alias("cid")).distinct().unionByName(pairs.select(F.col("b").alias("cid")).distinct())
    tried = stored(pivot_pairs(roots, classes), "pivot-pairs")
    links = stored(confirmed(tried, texts_of(ends(tried), classes, docs)), "links")
    known = stored(_with_comp(classes, components(links)), "components")
    nodes = roots.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select("node")
    pairs, stuck = path_pairs(_join_nodes(roots, nodes), known)
    pairs, stuck = stored(pairs.join(tried, ["a", "b"], "left_anti"), "path-pairs"), stored(stuck, "large-nodes")
    texts = texts_of(ends(pairs).unionByName(stuck.select("cid")), classes, docs)
    more = stored(confirmed(pairs, texts).unionByName(block_links(stuck, texts)), "links")
    if not more.isEmpty():
        known = stored(_with_comp(classes, components(links.unionByName(more))), "components")
    lowest = known.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    named = firsts.join(known.select("cid", "comp").join(lowest, "comp").select("cid", "comp", "component_id"), "cid").select("set_key", "comp", "class_id", "component_id")
    out = rows.select("doc_id", "th", "n_shingles", "set_key").join(named, "set_key", "left")
    alone = F.col("set_key").isNull()
    out = out.withColumns({c: F.when(alone, F.col("doc_id")).otherwise(F.col(c)) for c in ("class_id", "component_id")})
    return out.select("doc_id", "n_shingles", "class_id", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "th", "comp")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: the smallest id's, of several texts with that id any one.

    Rows are told apart by id and text, since ids may repeat or be null.  Texts
    without words are in no group; of such rows with the same id and text one stays.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("__id")
    kept = _components_of(docs).filter("kept").select(key, F.col("th").alias("__th"), "comp")
    one = kept.filter("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct("__id", "__th")).alias("r")).select("r.*")
    stay = one.unionByName(kept.filter("comp IS NULL").select("__id", "__th").distinct())
    rows = docs.withColumns({"__id": key, "__th": F.xxhash64(text_of())}).join(stay, ["__id", "__th"], "left_semi")
    return rows.dropDuplicates(["__id", "__th"]).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept", "class_id")
