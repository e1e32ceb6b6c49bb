"""One-to-one matching of similar rows, most similar first.

Two rows are as similar as the share of columns in which they agree, and may match from
a threshold on. Neither all pairs nor all pairs of a group are ever formed. A round

1. puts each row into several blocks (rows that agree on something lie in one block),
2. drops the blocks that only one side is in,
3. lets each row choose the smallest of its remaining blocks, and
4. matches, inside each block, the k-th chooser of one side with the k-th of the other.

The smallest block of all is chosen by all its rows, so each round matches something as
long as a block holds both sides; rounds repeat until none does. Blocks are counted,
ranked and joined in slices, so a block that holds a third of all rows (two columns of
few values) is spread over a thousand tasks.

``exact`` (the default, at any width) goes down level by level: on level s no remaining pair
agrees in more than s cells, so all pairs of a level are equally similar, any maximal
pairing is a best one, and in the end no acceptable pair is left. Cells that only one side
has are dead and taken out first; a row with fewer than s live cells has no partner on the level,
and levels that no row reaches are skipped. Live cells are ordered from rare to frequent. The
first k cells that a pair shares lie among the m-s+k rarest of either row, so rows are put
into nodes by their rare cells only. A node with few pairs lists and verifies them; any other
is split by a further cell, at most s deep, where all its rows agree in s cells and are
blocks as above. A level takes m-s+1 nodes per row unless frequent cells need splitting.

``subset`` blocks are exact too: at level s they are all subsets of s columns with the row's
cells, C(n, s) per row. ``lsh`` blocks are bands of a MinHash signature over the row's
(column, value) pairs, from long bands to short; their number does not grow with the columns, a
pair is verified against the threshold, and recall is high but not total. Both are for
those who ask for them by name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import cached_property, reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cells import similarity
from .groups import BROADCAST_KEYS, rows_in_groups, slice_of
from .stored import Workspace

BLOCK = ["b", "h1", "h2"]
# A node lists its pairs if they are at most this many per row.
PAIRS_PER_ROW = 16
# Before the first level, cells are counted in so many buckets, a megabyte in all; of tables with more columns each cell is.
BUCKETS, MOST_COLUMNS = 1 << 18, 32
PERMUTATIONS = 64
BAND_ROWS = (16, 8, 4, 2)
BLOCKS_PER_ARRAY = 50
# Partners in its block of bands that every row meets before its level may be left; as rows become fewer, as many
# as make this many pairs for each row there was.
BAND_WINDOW = 6
BAND_PAIRS_PER_ROW = 4
MOST_PARTNERS = 1024


def columns_needed(threshold: float, width: int) -> int:
    """Least number of equal cells that reaches the threshold (2 of 7 reaches 2/7)."""
    return max(0, math.ceil(threshold * width - 1e-9))


def minhash_signature(cells: Column, permutations: int = PERMUTATIONS, tagged: bool = False) -> Column:
    """MinHash of a row's cells: per seed, the least hash of any cell.

    ``tagged`` hashes a cell together with its position, so that equal values in
    different columns stay different.
    """

    def least(seed: Column) -> Column:
        if tagged:
            return F.array_min(F.transform(cells, lambda c, i: F.xxhash64(seed, i, c)))
        return F.array_min(F.transform(cells, lambda c: F.xxhash64(seed, c)))

    return F.transform(F.sequence(F.lit(0), F.lit(permutations - 1)), least)


def _blocks(members: Sequence[tuple[Sequence[str], Sequence[str]]]) -> list[Column]:
    """Arrays of blocks, each its number and a 128-bit hash of the named columns.

    Built as SQL text: with hundreds of blocks, column objects would take longer to make
    than the query takes to run. Cut into arrays that Spark can generate code for.
    """
    blocks = [
        f"struct({n} as b, xxhash64({', '.join(['1', *first])}) as h1, "
        f"xxhash64({', '.join(['2', *second])}) as h2)"
        for n, (first, second) in enumerate(members)
    ]
    return [
        F.expr(f"array({', '.join(blocks[i : i + BLOCKS_PER_ARRAY])})")
        for i in range(0, len(blocks), BLOCKS_PER_ARRAY)
    ]


def subset_blocks(subsets: Sequence[Sequence[int]]) -> list[Column]:
    """One block per column subset, from the cell hashes x0, y0, x1, y1, …"""
    return _blocks([([f"x{i}" for i in subset], [f"y{i}" for i in subset]) for subset in subsets])


def band_blocks(rows: int, permutations: int = PERMUTATIONS) -> list[Column]:
    """One block per band of ``rows`` consecutive signature values x0, x1, …"""
    bands = [[f"x{i}" for i in range(b, b + rows)] for b in range(0, permutations, rows)]
    return _blocks([(band, band) for band in bands])


class SimilarRows:
    """Matching of the stored leftover rows (rid, is_new, cells, copy, place).

    ``place`` is a hash of content and copy number: it orders rows inside a block, so the
    result does not depend on how the table was laid out.
    """

    def __init__(
        self,
        rows: DataFrame,
        width: int,
        *,
        threshold: float,
        matcher: str,
        workspace: Workspace,
    ):
        if matcher not in ("auto", "exact", "subset", "lsh"):
            raise ValueError(f"unknown matcher {matcher!r}")
        self.rows, self.width, self.workspace = rows, width, workspace
        self.threshold = threshold
        self.least_equal = columns_needed(threshold, width)
        self.matcher = "exact" if matcher == "auto" else matcher
        sides = rows.agg(
            F.count_if(~F.col("is_new")).alias("old"), F.count_if("is_new").alias("new")
        ).first()
        self.old_count, self.new_count = sides["old"], sides["new"]
        self._lengths: dict[int, tuple[DataFrame, int]] = {}

    # -- results --------------------------------------------------------------------

    @property
    def pair_count(self) -> int:
        return self._run[1]

    def matches(self) -> DataFrame:
        """Pairs: old_cells, new_cells, new_copy."""
        return self._with_cells(self._pairs())

    def unmatched(self) -> DataFrame:
        return self._left

    @cached_property
    def _left(self) -> DataFrame:
        return self._rows_left(self.rows, self._run[0])

    def _pairs(self) -> DataFrame:
        stored = self._run[0]
        if not stored:
            return self.rows.select(
                F.col("rid").alias("old_rid"), F.col("rid").alias("new_rid")
            ).where(F.lit(False))
        pairs = stored[0]
        for more in stored[1:]:
            pairs = pairs.unionAll(more)
        return pairs

    def _with_cells(self, pairs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        rows = self.rows if rows is None else rows
        old = rows.where(~F.col("is_new")).select(
            F.col("rid").alias("old_rid"), F.col("cells").alias("old_cells")
        )
        new = rows.where("is_new").select(
            F.col("rid").alias("new_rid"),
            F.col("cells").alias("new_cells"),
            F.col("copy").alias("new_copy"),
        )
        return pairs.join(old.hint("merge"), "old_rid").join(new.hint("merge"), "new_rid")

    # -- rounds ---------------------------------------------------------------------

    @cached_property
    def _run(self) -> tuple[list[DataFrame], int]:
        """Stored pairs of all rounds, and how many they are."""
        stored: list[DataFrame] = []
        found = 0
        if self.width == 0 or min(self.old_count, self.new_count) == 0:
            return stored, found
        rest = self.workspace.store(self._hashed())
        if self.matcher == "exact":
            return self._exact_run(rest)
        # Pairs found since the rows were last cut down to those left.
        since: list[DataFrame] = []
        rows_here = self.old_count + self.new_count
        for level in self._levels():
            edges = self.workspace.store(self._without_matched(self._edges(rest, level), since))
            fresh: list[DataFrame] = []
            turn = 0
            while min(self.old_count, self.new_count) > found:
                choices = self.workspace.store(self._choices(edges, fresh))
                most = choices.agg(F.max("blocks")).first()[0]
                if not most:
                    break
                if self.matcher == "lsh":
                    # Every row meets the partners of a window at once; the next window begins where it ends. A level
                    # is left once none of them, or of the whole block, can be matched with the rows that remain.
                    window = self._window(min(self.old_count, self.new_count) - found)
                    more = self._matched_edges(self._band_edges(choices, rest, turn, window))
                    turn += window
                else:
                    more = [pairs for pairs in [self._kept(self._paired(choices))] if self._length(pairs)]
                fresh += more
                found += sum(self._length(pairs) for pairs in more)
                # With one block per row there was nothing to choose: the level is done.
                if not more or (most == 1 and self.matcher != "lsh"):
                    break
            stored += fresh
            since += fresh
            if min(self.old_count, self.new_count) <= found:
                break
            # Rows are wide: they are written again only when half of them are gone.
            gone = 2 * sum(self._length(pairs) for pairs in since)
            if 2 * gone > rows_here:
                rest, since = self.workspace.store(self._rows_left(rest, since)), []
                rows_here -= gone
        return stored, found

    # -- exact levels ---------------------------------------------------------------

    def _exact_run(self, rest: DataFrame) -> tuple[list[DataFrame], int]:
        stored: list[DataFrame] = []
        found, level, live = 0, self.width - 1, None
        rough = self.width <= MOST_COLUMNS
        while level >= self.least_equal and min(self.old_count, self.new_count) > found:
            if rough:
                live = self._roughly_live(rest)
            else:
                if live is None:
                    live = self.workspace.store(self._live(rest))
                most = live.agg(
                    F.max(F.when(~F.col("is_new"), F.col("m"))).alias("old"),
                    F.max(F.when(F.col("is_new"), F.col("m"))).alias("new"),
                ).first()
                level = min(level, *(-1 if m is None else m for m in most))
                if level < self.least_equal:
                    break
            fresh = self._level_pairs(live.where(F.col("m") >= level), level)
            if fresh:
                found += sum(self._length(pairs) for pairs in fresh)
                stored += fresh
                rest, live = self.workspace.store(self._rows_left(rest, fresh)), None
            if rough:
                rough, live = False, None
            level -= 1
        return stored, found

    def _roughly_live(self, rows: DataFrame) -> DataFrame:
        """The same as ``_live`` without a shuffle of cells: a cell counts as live if its bucket holds both sides.

        That only adds to the live cells, and any order of cells that both sides share does; an estimate from its bucket and
        the distinct cells of its column keeps the rare ones first.
        """
        each = BUCKETS // self.width
        buckets = [F.pmod(F.col(f"x{i}"), F.lit(each)).cast("int") + i * each for i in range(self.width)]
        total = self.old_count + self.new_count
        kinds = rows.agg(*[F.approx_count_distinct(f"x{i}") for i in range(self.width)]).first()
        usual = F.element_at(F.array(*[F.lit(total // max(1, k)) for k in kinds]), F.expr(f"at div {each}").cast("int") + 1)
        counted = (
            rows.select("is_new", F.explode(F.array(*buckets)).alias("at"))
            .groupBy("at")
            .agg(F.count_if(~F.col("is_new")).alias("o"), F.count_if("is_new").alias("n"))
            .where("o > 0 and n > 0")
            .select("at", F.greatest(usual, F.col("o") + F.col("n") - total // each).alias("f"))
        )
        table = self.workspace.store(counted)
        known = rows
        for i, bucket in enumerate(buckets):
            column = table.where(F.col("at").between(i * each, (i + 1) * each - 1)).toDF(f"at{i}", f"f{i}")
            known = known.join(F.broadcast(column), bucket == F.col(f"at{i}"), "left").drop(f"at{i}")
        cells = F.sort_array(F.array(
            *[F.when(F.col(f"f{i}").isNotNull(), F.struct(F.col(f"f{i}").alias("f"), F.lit(i).alias("i"), F.col(f"x{i}").alias("x")))
              for i in range(self.width)]
        ))
        m = reduce(lambda a, b: a + b, [F.col(f"f{i}").isNotNull().cast("int") for i in range(self.width)])
        return known.select(
            "rid", "is_new", "place", F.slice(cells, self.width + 1 - m, m)["x"].alias("live"), m.alias("m")
        )

    def _live(self, rows: DataFrame) -> DataFrame:
        """Per row its cells that both sides have, from rare to frequent, and how many: m."""
        cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"x{i}").alias("x")) for i in range(self.width)])
        tokens = rows.select("rid", "is_new", F.inline(cells))
        both = (
            tokens.groupBy("i", "x")
            .agg(F.count_if(~F.col("is_new")).alias("o"), F.count_if("is_new").alias("n"))
            .where("o > 0 and n > 0")
            .select("i", "x", (F.col("o") + F.col("n")).alias("f"))
        )
        found = tokens.drop("is_new").join(both, ["i", "x"]).groupBy("rid").agg(
            *[F.max(F.when(F.col("i") == i, F.col("f"))).alias(f"f{i}") for i in range(self.width)]
        )
        live = F.array(
            *[F.struct(F.col(f"f{i}").alias("f"), F.lit(i).alias("i"), F.col(f"x{i}").alias("x")) for i in range(self.width)]
        )
        live = F.sort_array(F.filter(live, lambda x: x["f"].isNotNull()))
        return (
            rows.join(found, "rid", "left")
            .select("rid", "is_new", "place", live["x"].alias("live"))
            .withColumn("m", F.size("live"))
        )

    def _level_pairs(self, live: DataFrame, level: int) -> list[DataFrame]:
        """Stored pairs of one level, as many as it takes to leave none."""
        frontier = live.withColumns(
            {"at": F.lit(0), "n1": F.lit(0).cast("long"), "n2": F.lit(0).cast("long")}
        )
        if level == 0:
            return self._matched_blocks(self._node_blocks(frontier), [])
        listed: list[DataFrame] = []
        for depth in range(1, level + 1):
            frontier = self._split(frontier, level, depth)
            if depth == level:
                break
            # Cells travel once, to the rows that they are compared with or, of a large node, into the next depth.
            large = self._kept(self._large_nodes(frontier))
            listed.append(self._listed(self._outside(frontier, large), level))
            if not self._length(large):
                frontier = None
                break
            frontier = self.workspace.store(rows_in_groups(frontier, large, ["n1"]))
        pairs: list[DataFrame] = []
        if listed:
            pairs += self._matched_edges(self._kept(reduce(DataFrame.unionAll, listed).distinct()))
        if frontier is not None:
            pairs += self._matched_blocks(self._node_blocks(frontier), pairs)
        return pairs

    def _split(self, frontier: DataFrame, level: int, depth: int) -> DataFrame:
        """Nodes one cell deeper: the next cell among the m - level + depth rarest."""
        reach = F.col("m") - level + depth - F.col("at")
        cells = F.slice("live", F.col("at") + 1, F.greatest(reach, F.lit(0)))
        deeper = frontier.select("*", F.posexplode(cells).alias("step", "cell"))
        return deeper.select(
            "rid", "is_new", "place", "live", "m", (F.col("at") + F.col("step") + 1).alias("at"),
            *[F.xxhash64(F.lit(seed), "n1", "n2", "cell").alias(name)
              for seed, name in ((1, "n1"), (2, "n2"))],
        )

    @staticmethod
    def _large_nodes(frontier: DataFrame) -> DataFrame:
        """Nodes with more pairs than are listed, and their rows. Half of its hash tells a node that only lists pairs, as these
        are verified."""
        sizes = frontier.groupBy("n1").agg(F.count_if(~F.col("is_new")).alias("o"), F.count_if("is_new").alias("n"))
        large = F.col("o") * F.col("n") > PAIRS_PER_ROW * (F.col("o") + F.col("n"))
        return sizes.where(large).select("n1", (F.col("o") + F.col("n")).alias("n"))

    def _outside(self, frontier: DataFrame, large: DataFrame) -> DataFrame:
        length = self._length(large)
        return frontier.join(self._joined(large.select("n1"), length), "n1", "left_anti") if length else frontier

    def _node_blocks(self, frontier: DataFrame) -> DataFrame:
        """Stored: rows of the nodes that hold both sides, as blocks."""
        blocks = frontier.select(
            "rid", "is_new", "place", slice_of(F.col("place")).alias("slice"),
            F.lit(0).alias("b"), F.col("n1").alias("h1"), F.col("n2").alias("h2"),
        )
        shared = self._shared_blocks(blocks).select(*BLOCK, "slice")
        return self.workspace.store(blocks.join(shared.hint("merge"), [*BLOCK, "slice"]))

    @staticmethod
    def _listed(small: DataFrame, level: int) -> DataFrame:
        """The verified pairs of small nodes."""
        side = small.select("n1", "is_new", "rid", "place", F.col("live").alias("cells"))
        old = side.where(~F.col("is_new")).drop("is_new").toDF("n1", "old_rid", "old_place", "old_cells")
        new = side.where("is_new").drop("is_new").toDF("n1", "new_rid", "new_place", "new_cells")
        agree = F.size(F.array_intersect("old_cells", "new_cells"))
        return old.join(new.hint("merge"), "n1").where(agree >= level).select(
            "old_rid", "new_rid", F.lit(0).alias("fewer"), F.xxhash64("old_place", "new_place").alias("draw")
        )

    def _matched_edges(self, edges: DataFrame) -> list[DataFrame]:
        """A maximal matching: pairs that are each other's first choice, until no edge is left."""
        pairs: list[DataFrame] = []
        while self._length(edges):
            first = edges.groupBy("old_rid").agg(F.min(F.struct("fewer", "draw", "new_rid")).alias("c"))
            first = first.select("old_rid", "c.fewer", "c.draw", "c.new_rid")
            accepted = first.groupBy("new_rid").agg(F.min(F.struct("fewer", "draw", "old_rid")).alias("c"))
            chosen = self._kept(accepted.select("c.old_rid", "new_rid"))
            pairs.append(chosen)
            if self._length(chosen) == self._length(edges):
                break
            left = edges
            for side in ("old_rid", "new_rid"):
                left = left.join(self._joined(chosen.select(side), self._length(chosen)), side, "left_anti")
            turned = F.xxhash64("draw", F.lit(len(pairs))).alias("draw")
            edges = self._kept(left.select("old_rid", "new_rid", "fewer", turned))
        return pairs

    def _matched_blocks(self, blocks: DataFrame, before: list[DataFrame]) -> list[DataFrame]:
        """Rows of a block agree in enough cells: k-th with k-th, until no block has both sides."""
        pairs: list[DataFrame] = []
        while True:
            left = self._without_matched(blocks, before + pairs)
            choices = self.workspace.store(self._chosen(left))
            chosen = self._kept(self._paired(choices))
            if not self._length(chosen):
                return pairs
            pairs.append(chosen)

    def _hashed(self) -> DataFrame:
        """What blocks are made of, computed once, as plain columns of longs: a long text is
        hashed once however many blocks it is in."""
        cells = F.col("cells")
        if self.matcher == "lsh":
            # Equal cells have equal marks, so pairs with too few of them need not be looked at.
            marks = F.transform(cells, lambda c: F.hash(c)).alias("marks")
            if 1 < self.width <= MOST_COLUMNS:
                # The same values without nested functions of cells: Spark generates code for these.
                values = [
                    F.least(*[F.xxhash64(F.lit(seed), F.lit(i), cells[i]) for i in range(self.width)]).alias(f"x{seed}")
                    for seed in range(PERMUTATIONS)
                ]
                return self.rows.select("rid", "is_new", "place", marks, *values)
            signed = self.rows.select("rid", "is_new", "place", marks, minhash_signature(cells, tagged=True).alias("signature"))
            values = [F.col("signature")[i].alias(f"x{i}") for i in range(PERMUTATIONS)]
            return signed.select("rid", "is_new", "place", "marks", *values)
        if self.matcher == "exact":
            # 64 bits and the column tell cells apart: only cells of rows that meet are compared, and nodes have 128 bits.
            tokens = [F.xxhash64(F.lit(i), cells[i]).alias(f"x{i}") for i in range(self.width)]
            return self.rows.select("rid", "is_new", "place", *tokens)
        hashes = [
            F.xxhash64(F.lit(seed), cells[i]).alias(f"{name}{i}")
            for name, seed in (("x", 1), ("y", 2))
            for i in range(self.width)
        ]
        return self.rows.select("rid", "is_new", "place", *hashes)

    def _levels(self) -> Iterator[list[Column]]:
        if self.matcher == "lsh":
            for rows in BAND_ROWS:
                yield band_blocks(rows)
            return
        for size in range(self.width - 1, self.least_equal - 1, -1):
            yield subset_blocks(list(combinations(range(self.width), size)))

    def _kept(self, table: DataFrame) -> DataFrame:
        """A stored table whose length is known."""
        stored = self.workspace.store(table)
        self._lengths[id(stored)] = (stored, stored.count())
        return stored

    def _length(self, stored: DataFrame) -> int:
        return self._lengths[id(stored)][1]

    @staticmethod
    def _joined(rows: DataFrame, length: int) -> DataFrame:
        """The right side of a join: broadcast only if short, however small its file is."""
        return F.broadcast(rows) if length <= BROADCAST_KEYS else rows.hint("merge")

    def _without_matched(self, rows: DataFrame, pairs: list[DataFrame]) -> DataFrame:
        if not pairs:
            return rows
        matched = reduce(DataFrame.unionAll, pairs).select(F.explode(F.array("old_rid", "new_rid")).alias("rid"))
        length = 2 * sum(self._length(stored) for stored in pairs)
        return rows.join(self._joined(matched, length), "rid", "left_anti")

    def _rows_left(self, rows: DataFrame, pairs: list[DataFrame]) -> DataFrame:
        """The same of wide rows: after many pairs ids alone are shuffled to tell which are left, and of the rows mostly those."""
        if 2 * sum(self._length(stored) for stored in pairs) <= BROADCAST_KEYS:
            return self._without_matched(rows, pairs)
        left = self._without_matched(rows.select("rid"), pairs).withColumn("n", F.lit(1).cast("long"))
        return rows_in_groups(rows, self.workspace.store(left), ["rid"])

    def _edges(self, rows: DataFrame, blocks: list[Column]) -> DataFrame:
        """Each row's blocks that hold both sides: as rows are matched they become fewer, never more."""
        parts = [
            rows.select("rid", "is_new", "place", slice_of(F.col("place")).alias("slice"), F.inline(b))
            for b in blocks
        ]
        edges = reduce(DataFrame.unionAll, parts)
        shared = self._shared_blocks(edges).select(*BLOCK, "slice")
        return edges.join(shared.hint("merge"), [*BLOCK, "slice"])

    def _choices(self, edges: DataFrame, matched: list[DataFrame]) -> DataFrame:
        """Each row's smallest block among those that still hold both sides."""
        return self._chosen(self._without_matched(edges, matched))

    def _chosen(self, edges: DataFrame) -> DataFrame:
        shared = self._shared_blocks(edges).select(
            *BLOCK, "slice", (F.col("old") + F.col("new")).alias("size")
        )
        smallest = F.min(F.struct("size", *BLOCK)).alias("block")
        return (
            edges.join(shared.hint("merge"), [*BLOCK, "slice"])
            .groupBy("rid", "is_new", "place", "slice")
            .agg(smallest, F.count(F.lit(1)).alias("blocks"))
            .select("rid", "is_new", "place", "slice", "block.b", "block.h1", "block.h2", "blocks")
        )

    def _shared_blocks(self, edges: DataFrame) -> DataFrame:
        """Per (block, slice): rows of each side in the whole block and before the slice;
        only blocks that hold both sides."""
        per_slice = edges.groupBy(*BLOCK, "slice").agg(
            F.count_if(~F.col("is_new")).alias("o"), F.count_if("is_new").alias("n")
        )
        whole = Window.partitionBy(*BLOCK)
        before = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        return per_slice.select(
            *BLOCK,
            "slice",
            F.sum("o").over(whole).alias("old"),
            F.sum("n").over(whole).alias("new"),
            F.coalesce(F.sum("o").over(before), F.lit(0)).alias("old_before"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("new_before"),
        ).where("old > 0 and new > 0")

    def _ranked(self, choices: DataFrame) -> DataFrame:
        """Choosers with their rank on their side of their block, and the choosers of both sides."""
        within = Window.partitionBy(*BLOCK, "slice", "is_new").orderBy("place", "rid")
        before = F.when(F.col("is_new"), F.col("new_before")).otherwise(F.col("old_before"))
        shared = self._shared_blocks(choices).hint("merge")
        return choices.join(shared, [*BLOCK, "slice"]).withColumn("rank", before + F.row_number().over(within))

    def _paired(self, choices: DataFrame) -> DataFrame:
        """k-th old with k-th new chooser of each block: old_rid, new_rid."""
        return self._ranked(choices).where(F.col("rank") <= F.least("old", "new")).groupBy(*BLOCK, "rank").agg(
            F.max(F.when(~F.col("is_new"), F.col("rid"))).alias("old_rid"),
            F.max(F.when(F.col("is_new"), F.col("rid"))).alias("new_rid"),
        ).select("old_rid", "new_rid")

    def _window(self, left: int) -> int:
        """How many partners a row meets at once when ``left`` pairs may still be found."""
        budget = BAND_PAIRS_PER_ROW * (self.old_count + self.new_count)
        return min(MOST_PARTNERS, max(BAND_WINDOW, budget // left))

    def _band_edges(self, choices: DataFrame, rows: DataFrame, turn: int, window: int) -> DataFrame:
        """Stored: the verified pairs among those of each row of a block's smaller side with ``window`` rows of the larger."""
        # Of the wide rows and of their texts, only those asked for are shuffled.
        marks = rows_in_groups(rows.select("rid", "marks"), choices.select("rid", F.lit(1).cast("long").alias("n")), ["rid"])
        ranked = self._ranked(choices).join(marks.hint("merge"), "rid")
        ranked = self.workspace.store(ranked.select(*BLOCK, "rank", "rid", "is_new", "place", "marks", "old", "new"))
        on_larger = F.col("is_new") == (F.col("new") >= F.col("old"))
        size = F.greatest("old", "new")
        larger = ranked.where(on_larger).select(*BLOCK, "rank", *[F.col(c).alias(f"_{c}") for c in ("rid", "place", "marks")])
        steps = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(window), size) - 1)).alias("step")
        smaller = ranked.where(~on_larger).select("*", steps)
        smaller = smaller.withColumn("rank", F.pmod(F.col("rank") - 1 - F.lit(turn) - F.col("step"), size) + 1)
        enough = F.lit(self.least_equal / self.width - 1e-9)
        likely = smaller.join(larger.hint("merge"), [*BLOCK, "rank"]).where(similarity(F.col("marks"), F.col("_marks")) >= enough)
        old = F.when(F.col("is_new"), F.col("_rid")).otherwise(F.col("rid"))
        new = F.when(F.col("is_new"), F.col("rid")).otherwise(F.col("_rid"))
        pairs = self._kept(likely.select(
            old.alias("old_rid"), new.alias("new_rid"),
            F.xxhash64(F.least("place", "_place"), F.greatest("place", "_place")).alias("draw"),
        ))
        if not self._length(pairs):
            return pairs
        share = similarity(F.col("old_cells"), F.col("new_cells"))
        met = self._rows_met(self.rows, pairs)
        return self._kept(self._with_cells(pairs, met).where(share >= enough).select(
            "old_rid", "new_rid", (self.width - F.round(share * self.width)).cast("int").alias("fewer"), "draw"
        ))

    def _rows_met(self, rows: DataFrame, pairs: DataFrame) -> DataFrame:
        """The rows of stored pairs, which may repeat."""
        rids = pairs.select(F.explode(F.array("old_rid", "new_rid")).alias("rid"))
        if 2 * self._length(pairs) <= BROADCAST_KEYS:
            return rows.join(F.broadcast(rids), "rid", "left_semi")
        return rows_in_groups(rows, self.workspace.store(rids.groupBy("rid").agg(F.count(F.lit(1)).alias("n"))), ["rid"])
