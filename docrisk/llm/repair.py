"""Repair of conversation structure: the cheapest edits that make the roles read ``(s?(ua)+)?``.

Rows of a conversation come in order of turn (those without one first, then by role and text). A row is faulty if it
is blank, repeats an earlier row's role and text, or is cut off (its last visible character is no ``.``, ``!`` or
``?``). Edits: Keep 0; Rerole to user or assistant 1; Delete 2, which blank and repeated rows need; Insert an empty
user or assistant row anywhere 5; a row that is cut off and not deleted costs 5 more. Of the cheapest edits those
whose initials are least in ASCII order are taken.

Method: the grammar is an automaton of four states (nothing yet, after system, after user, after assistant). A Viterbi
pass keeps the best path to each state in a tree of back pointers. A node counts who refers to it; branches nobody
refers to are freed, and when the root has one child and no path ends there, all paths share that edit: it is emitted
and its row let go. A path that another one is sure to beat is dropped, so that paths come together soon; paths of
equal cost are compared by their whole edits since they parted, however long those are. Memory is therefore that of
the edits not yet decided, not of the conversation, which is read as a stream from sorted partitions and never gathered.
Some conversations decide nothing before their end (rows of users alone: their number tells which one goes); there the
memory grows with the conversation, and a comparison climbs all of it.

One exchange brings a conversation's rows together; its repeated rows are marked by a window over hashes of role and
text in that same partitioning. A very long conversation is one sorted stream in one task, as its edits depend on
each other and the hash of its repaired text has to be taken in order.

Null role and text count as one space. Null conv_id is a conversation like any other. Null turns come first. Very long
texts are held only while their edit is open. Equal rows of one turn keep side by side. Extra columns are ignored,
whatever their names. An empty table gives no rows. A row with ``present`` false only names its conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
CUT_OFF = 5
# The state after a role initial, and the role that an inserted or reroled row takes in a state.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WANTED = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\x0c\r"
STOPS = (".", "!", "?")


# ---- the pass over one conversation --------------------------------------------------------------------------
class Node:
    """One edit of a path: letter, the role it leaves and its row, the edit before, and who refers to it."""

    __slots__ = ("letter", "role", "row", "parent", "refs", "children")

    def __init__(self, letter: str, role: str | None, row, parent: Node | None):
        self.letter, self.role, self.row, self.parent = letter, role, row, parent
        self.refs = 0  # paths that end here
        self.children: list[Node] = []

    def grow(self, letter: str, role: str | None, row) -> Node:
        child = Node(letter, role, row, self)
        self.children.append(child)
        return child


def letters_since_parting(a: Node, b: Node) -> tuple[str, str]:
    """Edits of two paths after their last common one, complete."""
    up_a, up_b = [a], [b]
    at_a, at_b = {id(a): 0}, {id(b): 0}
    while True:  # climb in turn, so that the work is that of the parted ends
        x, y = up_a[-1], up_b[-1]
        if id(x) in at_b:
            i, j = len(up_a) - 1, at_b[id(x)]
            break
        if id(y) in at_a:
            i, j = at_a[id(y)], len(up_b) - 1
            break
        if x.parent is not None:
            up_a.append(x.parent)
            at_a[id(x.parent)] = len(up_a) - 1
        if y.parent is not None:
            up_b.append(y.parent)
            at_b[id(y.parent)] = len(up_b) - 1
    return "".join(n.letter for n in reversed(up_a[:i])), "".join(n.letter for n in reversed(up_b[:j]))


class Viterbi:
    """Survivors of one conversation; ``step`` takes a row, ``finish`` ends it; both return the edits now decided.

    A decided edit is (letter, role, row), without row for an inserted one.
    """

    def __init__(self):
        self.root = Node("", None, None, None)
        self.root.refs = 1
        self.paths: dict[int, tuple[int, Node]] = {START: (0, self.root)}
        self.open = 0  # edits not yet decided, over all paths

    def less(self, a: tuple[int, Node, str], b: tuple[int, Node, str]) -> bool:
        """Whether path a, with one more letter, comes before b: by cost, then by all their letters."""
        if a[0] != b[0]:
            return a[0] < b[0]
        if a[1] is b[1]:
            return a[2] < b[2]
        x, y = letters_since_parting(a[1], b[1])
        return x + a[2] < y + b[2]

    def insert(self) -> None:
        """Inserted rows between two rows: twice, as the system row alone may be followed by two."""
        for _ in range(2):
            for state in list(self.paths):
                cost, node = self.paths[state]
                role, after = WANTED[state]
                old = self.paths.get(after)
                if old is None or self.less((cost + COST[INSERT], node, INSERT), (old[0], old[1], "")):
                    child = node.grow(INSERT, role, None)
                    self.open += 1
                    child.refs = 1
                    self.paths[after] = (cost + COST[INSERT], child)
                    if old is not None:
                        self.release(old[1])

    def step(self, row, initial: str, must_go: bool, cut_off: bool) -> list[tuple]:
        """``initial``: of the row's role; the row itself is only handed through."""
        self.insert()
        best: dict[int, tuple[int, Node, str, str | None]] = {}

        def offer(after: int, cost: int, node: Node, letter: str, role: str | None) -> None:
            old = best.get(after)
            if old is None or self.less((cost, node, letter), old[:3]):
                best[after] = (cost, node, letter, role)

        extra = CUT_OFF if cut_off else 0
        for state, (cost, node) in self.paths.items():
            offer(state, cost + COST[DELETE], node, DELETE, None)
            if not must_go:
                if (state, initial) in NEXT:
                    offer(NEXT[state, initial], cost + COST[KEEP] + extra, node, KEEP, None)
                role, after = WANTED[state]
                offer(after, cost + COST[REROLE] + extra, node, REROLE, role)
        before = self.paths
        self.paths = {}
        for state, (cost, node, letter, role) in best.items():
            child = node.grow(letter, role, row if letter != DELETE else None)
            self.open += 1
            child.refs = 1
            self.paths[state] = (cost, child)
        for _, node in before.values():
            self.release(node)
        self.drop_beaten()
        return self.decided()

    def drop_beaten(self) -> None:
        """Drop a path that another one does better from here on, whatever follows.

        Nothing yet or after an assistant's row, the same edits lead on; after a system row too, but it is no end.
        What begins with a system row can be had after an assistant's row by deleting that one, for 2 more.
        """
        paths = self.paths
        for state, by in ((ASSISTANT, START), (SYSTEM, START), (SYSTEM, ASSISTANT)):
            if state in paths and by in paths and self.less((*paths[by], ""), (*paths[state], "")):
                self.release(paths.pop(state)[1])
        if START in paths and ASSISTANT in paths and paths[ASSISTANT][0] + COST[DELETE] < paths[START][0]:
            self.release(paths.pop(START)[1])

    def release(self, node: Node) -> None:
        """A path leaves ``node``: free it and what only it held."""
        node.refs -= 1
        while not node.refs and not node.children and node.parent is not None:
            parent = node.parent
            parent.children.remove(node)
            node.parent = node.row = None
            self.open -= 1
            node = parent

    def decided(self) -> list[tuple]:
        out = []
        while not self.root.refs and len(self.root.children) == 1:
            self.root = self.root.children[0]
            self.root.parent = None
            self.open -= 1
            out.append((self.root.letter, self.root.role, self.root.row))
            self.root.row = None
        return out

    def finish(self) -> tuple[int, list[tuple]]:
        """Cost of the best path, and its edits that were still open."""
        self.insert()
        ends = [self.paths[s] for s in (START, ASSISTANT) if s in self.paths]
        best = ends[0]
        for other in ends[1:]:
            if self.less((*other, ""), (*best, "")):
                best = other
        for _, node in self.paths.values():
            if node is not best[1]:
                self.release(node)
        return best[0], self.decided()


# ---- conversations as streams of rows ------------------------------------------------------------------------
def marked(turns: DataFrame) -> DataFrame:
    """Rows by conversation in order, with ``initial``, ``blank``, ``again`` and ``cut_off``.

    ``turns``: conv_id, turn, role, text and, if given, ``present``. Faults are JVM expressions computed before the
    exchange; only rows without a deleting fault carry their text from there on.
    """
    present = F.coalesce(F.col("present"), F.lit(True)) if "present" in turns.columns else F.lit(True)
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), present.alias("present"))
    visible: Column = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = rows.select(
        "conv_id", "turn", "role", "text", "present", (visible == "").alias("blank"), (~F.substring(visible, -1, 1).isin(*STOPS)).alias("cut_off"),
        F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(7), "role", "text").alias("h2"),
    )
    together = rows.repartition("conv_id")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    nth = F.row_number().over(Window.partitionBy("conv_id", "present", "h1", "h2").orderBy(F.col("turn").asc_nulls_first()))
    ranked = together.withColumn("nth", nth).withColumn("again", F.col("nth") > 1)
    in_order = ranked.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order, "nth")
    goes = F.col("blank") | F.col("again")
    return in_order.select(
        "conv_id", "turn", "role", F.when(~goes & F.col("present"), F.col("text")).alias("text"), "present", F.substring("role", 1, 1).alias("initial"),
        "blank", (F.col("again") & ~F.col("blank")).alias("again"), (F.col("cut_off") & ~goes).alias("cut_off"),
    )


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, row or None) in order; None ends a conversation. Rows are the columns of ``marked`` after the id."""
    current = open_ = None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for conv, *row in zip(*columns):
            if open_ and conv != current:
                yield current, None
            current, open_ = conv, True
            yield conv, row
    if open_:
        yield current, None


EDIT_SCHEMA = "conv_id long, position long, edit string, turn long, role string, text string"
_EDITS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _kept(letter: str, role: str | None, row) -> tuple:
    """(turn, role, text) that an edit leaves; a deleted row leaves none."""
    if letter == DELETE:
        return None, None, None
    if letter == INSERT:
        return None, role, ""
    return row[0], role or row[1], row[2]


def edits(turns: DataFrame) -> DataFrame:
    """One row per edit, in order of ``position``: edit (K, R, D, I) and, but for D, the turn, role and text it leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, path, at = [], 0, Viterbi(), 0
        for conv, row in conversations(batches):
            if row is None:
                done = path.finish()[1]
            elif row[3]:
                done = path.step((row[0], row[1], row[2]), row[4], row[5] or row[6], row[7])
            else:
                continue
            for letter, role, kept in done:
                rows.append((conv, at, letter, *_kept(letter, role, kept)))
                held += len(rows[-1][5] or "")
                at += 1
            if row is None:
                path, at = Viterbi(), 0
            if len(rows) >= 5000 or held > 1 << 23:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _EDITS)], schema=_EDITS)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _EDITS)], schema=_EDITS)

    return marked(turns).mapInArrow(run, EDIT_SCHEMA)


REPORT_SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, most_open long"
_REPORT = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string()), ("most_open", pa.int64())])


class Report:
    """What is said of one conversation; fed with rows and decided edits."""

    def __init__(self):
        self.path, self.audit, self.sha = Viterbi(), [], hashlib.sha256()
        self.first = self.last = self.initial = None
        self.distinct = self.blank = self.again = self.cut_off = self.illegal = self.most_open = 0
        self.lines = 0

    def row(self, turn, role, text, initial, blank, again, cut_off) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.distinct = turn, self.distinct + 1
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL
        self.initial = initial
        self.blank, self.again, self.cut_off = self.blank + blank, self.again + again, self.cut_off + cut_off
        self.note(self.path.step((turn, role, text), initial, blank or again, cut_off))
        self.most_open = max(self.most_open, self.path.open)

    def note(self, done: list[tuple]) -> None:
        for letter, role, row in done:
            self.audit.append(letter)
            if letter != DELETE:
                _, role, text = _kept(letter, role, row)
                self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
                self.lines += 1

    def result(self, conv) -> tuple:
        cost, done = self.path.finish()
        self.note(done)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (conv, gaps, self.blank, self.again, self.cut_off, self.illegal, cost, "".join(self.audit), self.sha.hexdigest(), self.most_open)


def reports(turns: DataFrame) -> DataFrame:
    """One row per conversation: counts of gaps, faults and illegal pairs, cost and initials of the edits, and the SHA-256
    of the repaired ``role:text`` lines. ``most_open`` is the largest number of edits that were undecided at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, report = [], Report()
        for conv, row in conversations(batches):
            if row is not None:
                turn, role, text, present, *rest = row
                if present:
                    report.row(turn, role, text, *rest)
                continue
            rows.append(report.result(conv))
            report = Report()
            if len(rows) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _REPORT)], schema=_REPORT)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _REPORT)], schema=_REPORT)

    return marked(turns).mapInArrow(run, REPORT_SCHEMA)


# ---- damage --------------------------------------------------------------------------------------------------
def damage(turns: DataFrame) -> DataFrame:
    """Rows dropped, emptied, stripped of their stops, repeated or given to the user, by a CRC of ``conv_id:turn``.

    A dropped row stays as one that only names its conversation (``present`` false).
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), k.alias("k"))
    text = F.when(F.col("k").isin(0, 1), F.lit("")).when(F.col("k") == 2, F.translate("text", "".join(STOPS), "")).otherwise(F.col("text"))
    times = F.when(F.col("k") == 3, F.lit(2)).otherwise(F.lit(1))
    return rows.select(
        "conv_id", "turn", F.when(F.col("k") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("k") != 0).alias("present"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("copy"),
    ).drop("copy")
