"""Conversation structure repair: the cheapest edits that make a conversation ``(s?(ua)+)?`` by its roles' initials.

Each row is kept (K, free), given the role user or assistant (R, 3) or deleted
(D, 4; a must for blank rows and repeats); rows user or assistant with empty
text may be inserted anywhere (I, 3).  A truncated row that stays adds 3.  Of the
cheapest edits those whose letters are least in ASCII are taken.

The search is a Viterbi pass over four states (nothing yet, after s, after u,
after a) with survivor coalescence: survivors are leaves of one tree of
backpointers.  A node is freed when nothing refers to it; when all survivors
share the root's only child, that edit is settled, is put out and the child
becomes the root.  Ties compare the two paths' whole unresolved ends (by jump
pointers, so in logarithmic time).  A survivor that another beats whatever
follows is dropped, which lets the rest coalesce.  So a task holds what is still
undecided, not a conversation.

A pass reads no texts, but rows of some 40 bytes: keys, initial, flags, and a
128-bit hash of role and text.  Repeats are found by the first turn of each such
hash, an aggregate, so that a hot conversation is reduced before it moves; texts
meet their edits by the same keys.  The rows of one conversation pass one task
in order, as a stream.

Defined results: null role or text is one space (a blank text; a role that can't
be kept); rows are taken by turn, null turns first, then by role and a hash of
role and text, so equal rows are interchangeable; null ids are one conversation;
a conversation without rows has no edits; an empty table gives no rows; other
columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.llm.common import stored, table

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NOTHING, AFTER_S, AFTER_U, AFTER_A = range(4)
_NEXT = {NOTHING: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}  # by a user or assistant row
_KEEP = {
    "s": {NOTHING: AFTER_S},
    "u": {NOTHING: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U},
    "a": {AFTER_U: AFTER_A},
}
#: (i, j): what follows costs at most so much more from state j than from state i, whatever it is.
_BEHIND = {
    (NOTHING, AFTER_A): DELETE,
    (NOTHING, AFTER_U): DELETE + INSERT,
    (AFTER_S, NOTHING): 0,
    (AFTER_S, AFTER_A): 0,
    (AFTER_S, AFTER_U): INSERT,
    (AFTER_U, AFTER_A): INSERT,
    (AFTER_A, AFTER_U): INSERT,
}
_ROLE = {AFTER_U: "user", AFTER_A: "assistant"}
FLUSH = 20_000
BLANK_WORD = r"[^\x20\x09-\x0D]"


class Edit:
    """A node of the backpointer tree: one edit after its parent's."""

    __slots__ = ("parent", "letter", "depth", "refs", "jump", "child", "out")

    def __init__(self, parent: Edit | None, letter: str, out: tuple | None) -> None:
        self.parent, self.letter, self.out = parent, letter, out
        self.refs, self.child = 0, None
        if parent is None:
            self.depth, self.jump = 0, None
            return
        self.depth = parent.depth + 1
        parent.refs += 1
        parent.child = self
        far = parent.jump
        even = far is not None and far.jump is not None and parent.depth - far.depth == far.depth - far.jump.depth
        self.jump = far.jump if even else parent


class Repair:
    """The edits of one conversation, row by row; ``put`` takes each as it is settled."""

    def __init__(self, put) -> None:
        self.put = put
        self.root = Edit(None, "", None)
        self.root.refs = 1
        self.best: dict[int, tuple[int, Edit]] = {NOTHING: (0, self.root)}
        self.most = 1  # unresolved edits at once
        self._insert()

    def _lift(self, node: Edit, depth: int) -> Edit:
        while node.depth > depth:
            far = node.jump
            node = far if far is not None and far.depth >= depth and far.depth >= self.root.depth else node.parent
        return node

    def _less(self, a: Edit, x: str, b: Edit, y: str) -> bool:
        """Whether the letters up to ``a`` and then ``x`` come before those up to ``b`` and then ``y``."""
        if a is b:
            return x < y
        if a.depth < b.depth:
            up = self._lift(b, a.depth + 1)
            if up.parent is a:
                return x <= up.letter
            b = up.parent
        elif b.depth < a.depth:
            up = self._lift(a, b.depth + 1)
            if up.parent is b:
                return up.letter < y
            a = up.parent
        while a.parent is not b.parent:
            p, q = a.jump, b.jump
            if p is not q and p is not None and q is not None and p.depth == q.depth >= self.root.depth:
                a, b = p, q
            else:
                a, b = a.parent, b.parent
        return a.letter < b.letter

    def _free(self, node: Edit) -> None:
        while True:
            node.refs -= 1
            if node.refs or node is self.root:
                return
            parent = node.parent
            node.parent = node.jump = node.child = None
            node = parent

    def _insert(self) -> None:
        """Follows insertions from every survivor, as long as they give a better one."""
        changed = True
        while changed:
            changed = False
            for s in list(self.best):
                cost, node = self.best[s]
                to, total = _NEXT[s], cost + INSERT
                there = self.best.get(to)
                if there is None or total < there[0] or (total == there[0] and self._less(node, "I", there[1].parent, there[1].letter)):
                    new = Edit(node, "I", (None, _ROLE[to]))
                    new.refs = 1
                    self.best[to] = (total, new)
                    if there is not None:
                        self._free(there[1])
                    changed = True

    def row(self, key: tuple, role: str, must_go: bool, truncated: bool) -> None:
        """Takes the next row; ``key`` names it in what is put out."""
        found: dict[int, tuple[int, Edit, str]] = {}

        def offer(to: int, cost: int, node: Edit, letter: str) -> None:
            there = found.get(to)
            if there is None or cost < there[0] or (cost == there[0] and self._less(node, letter, there[1], there[2])):
                found[to] = (cost, node, letter)

        keep, more = _KEEP.get(role[:1], {}), TRUNCATED if truncated else 0
        for s, (cost, node) in self.best.items():
            offer(s, cost + DELETE, node, "D")
            if not must_go:
                offer(_NEXT[s], cost + REROLE + more, node, "R")
                if s in keep:
                    offer(keep[s], cost + more, node, "K")
        before, self.best = self.best, {}
        for to, (cost, node, letter) in found.items():
            out = None if letter == "D" else (key, role if letter == "K" else _ROLE[to])
            new = Edit(node, letter, out)
            new.refs = 1
            self.best[to] = (cost, new)
        for _, node in before.values():
            self._free(node)
        self._insert()
        self._settle()

    def _settle(self) -> None:
        costs = {s: c for s, (c, _) in self.best.items()}
        for (i, j), behind in _BEHIND.items():
            if i in self.best and j in self.best and costs[j] + behind < costs[i]:
                self._free(self.best.pop(i)[1])
        root = self.root
        while root.refs == 1 and all(root is not n for _, n in self.best.values()):
            child = self._only(root)
            self.put(child.letter, child.out)
            child.parent = None
            root.child = root.jump = None
            self.root = root = child
        self.most = max(self.most, max(n.depth for _, n in self.best.values()) - root.depth)

    def _only(self, root: Edit) -> Edit:
        """The one child of ``root``: the last one made, if that is there still; else the way up from a survivor tells."""
        child = root.child
        if child is not None and child.parent is root:
            return child
        _, node = next(iter(self.best.values()))
        return self._lift(node, root.depth + 1)

    def end(self) -> int:
        """Puts out what is left of the best path to an end, and gives its cost."""
        ends = [self.best[s] for s in (NOTHING, AFTER_A) if s in self.best]
        cost, node = ends[0]
        for c, n in ends[1:]:
            if c < cost or (c == cost and self._less(n, "", node, "")):
                cost, node = c, n
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self.put(node.letter, node.out)
        return cost


def key_of(conv_id: str) -> Column:
    """A text that names a conversation, the null one too."""
    c = F.col(conv_id)
    return F.when(c.isNull(), "null").otherwise(F.concat(F.lit("id:"), c.cast("string")))


_OUT = (
    "conv string, place long, edit string, role string, h1 long, h2 long, "
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
)
_NAMES = [f.split()[0] for f in _OUT.split(", ")]
_TYPES = [pa.string() if f.endswith("string") else pa.int64() for f in _OUT.split(", ")]
_LEGAL = {"su", "ua", "au"}


class _Conversation:
    """One conversation as its rows come: counts, and its repair."""

    def __init__(self, conv: str, emit) -> None:
        self.conv, self.emit = conv, emit
        self.low = self.high = self.turn = self.before = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.place = 0
        self.audit: list[str] = []
        self.repair = Repair(self._put)

    def _put(self, letter: str, out: tuple | None) -> None:
        self.audit.append(letter)
        if len(self.audit) > 4096:
            self.audit = ["".join(self.audit)]
        if out is not None:
            (h1, h2), role = out[0] or (None, None), out[1]
            self.emit(self.conv, self.place, letter, role, h1, h2, *[None] * 7)
            self.place += 1

    def row(self, turn: int | None, role: str, h: tuple[int, int], blank: bool, again: bool, unfinished: bool) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        if self.before is not None:
            self.illegal += self.before + role[:1] not in _LEGAL
        self.before = role[:1]
        self.blank += blank
        self.duplicate += again and not blank
        cut = unfinished and not (blank or again)
        self.truncated += cut
        self.repair.row(h, role, blank or again, cut)

    def end(self) -> None:
        cost = self.repair.end()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        counts = (gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost)
        self.emit(self.conv, *[None] * 5, *counts, "".join(self.audit))


def _repair_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn to edits that stay, and a row of counts and letters for each conversation."""
    columns: list[list] = [[] for _ in _NAMES]

    def emit(*values) -> None:
        for column, v in zip(columns, values, strict=True):
            column.append(v)

    def flushed() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)
        for c in columns:
            c.clear()
        return made

    now, last = None, None
    for batch in batches:
        names = ("conv", "turn", "role", "h1", "h2", "blank", "unfinished", "first", "first_null")
        for conv, turn, role, h1, h2, blank, unfinished, first, first_null in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    now.end()
                now, last = _Conversation(conv, emit), None
            here = (turn, role, h1, h2)
            again = here == last or not (turn is None if first_null else turn == first)
            last = here
            now.row(turn, role, (h1, h2), blank, again, unfinished)
            if len(columns[0]) >= FLUSH:
                yield flushed()
    if now is not None:
        now.end()
    yield flushed()


def _named(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, h1, h2 of the rows."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(key_of("conv_id").alias("conv"), F.col("turn").cast("long"), space("role").alias("role"), space("text").alias("text"))
    return rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64("text", F.lit(7), "role")})


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repaired rows (conv, place, edit, role, text) and, for each conversation that has rows, its counts, cost and audit.

    ``rows`` has conv_id, turn, role and text; ``conv`` is ``key_of("conv_id")``.
    """
    named = _named(rows)
    slim = named.select(
        *("conv", "turn", "role", "h1", "h2"),
        (~F.col("text").rlike(BLANK_WORD)).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("unfinished"),
    )
    first = slim.groupBy("conv", "h1", "h2").agg(F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("first_null"))
    flagged = slim.join(first, ["conv", "h1", "h2"])
    ordered = flagged.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "h1", "h2")
    done = stored(ordered.mapInArrow(_repair_stream, _OUT), "repaired")
    edits = done.filter("place IS NOT NULL").select("conv", "place", "edit", "role", "h1", "h2")
    texts = named.select("conv", "h1", "h2", "text").dropDuplicates(["conv", "h1", "h2"])
    kept = edits.filter("edit <> 'I'").join(texts, ["conv", "h1", "h2"]).select("conv", "place", "edit", "role", "text")
    inserted = edits.filter("edit = 'I'").select("conv", "place", "edit", "role", F.lit("").alias("text"))
    return kept.unionByName(inserted), done.filter("place IS NULL").select("conv", *_NAMES[6:])


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with what a hash of conversation and turn does to them: dropped, emptied, unpunctuated, repeated, made a user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    rows = rows.filter("kind <> 0").withColumns(
        {
            "text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
            "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")),
            "copies": F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))),
        }
    )
    return rows.select("conv_id", "turn", "role", "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    repaired, counts = repair(damage(conversations))
    line = F.struct("place", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = repaired.groupBy("conv").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    whole = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    digests = lines.select("conv", F.sha2(F.encode(whole, "UTF-8"), 256).alias("digest"))
    ids = conversations.select("conv_id", key_of("conv_id").alias("conv")).distinct()
    found = ids.join(counts, "conv", "left").join(digests, "conv", "left")
    numbers = (F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    nothing = F.sha2(F.encode(F.lit(""), "UTF-8"), 256)
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", nothing).alias("repaired_sha256"))
