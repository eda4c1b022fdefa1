"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

A uniformly random permutation of all rows, cut into shards, can be drawn in three steps that
never look at all rows at once:

1. Draw how many rows each block (a group of input partitions) sends to each shard. These counts
   follow the multivariate hypergeometric law with the blocks' and shards' sizes as margins.
2. Permute each block and send its first rows to shard 0, the next to shard 1, and so on.
3. Permute each shard.

Everything is a DataFrame expression. The matrix is drawn down a binary tree over the blocks: a
node knows how many of its rows go to each shard and draws how many of these come from its left
half. The nodes of a level are independent rows, and no level needs more than the counts.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ehrseq.llm.common import stage

# The tree has at most 2 ** BLOCK_BITS leaves; partitions beyond share blocks. Bounds the matrix.
BLOCK_BITS = 12
# Rows of a shard ranked in one task, about.
ROWS_PER_BUCKET = 200_000
# Random bits of a row that choose its bucket.
BUCKET_BITS = 20


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _uniform(*key: Column) -> Column:
    """A number in [0, 1) from 53 hashed bits of the key."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) / F.lit(float(1 << 53))


def _hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` rows out of ``total`` are among the ``good`` ones, by inversion of ``u``.

    Probabilities are taken relative to the mode's and walked outwards over the mode plus or minus
    twelve standard deviations (and 40), outside of which less than 2**-53 of the mass lies.
    """

    def with_facts(x):
        n, k, t = x.drawn.cast("double"), x.good.cast("double"), x.total.cast("double")
        low = F.greatest(F.lit(0).cast("bigint"), x.drawn + x.good - x.total)
        high = F.least(x.drawn, x.good)
        mode = F.greatest(low, F.least(high, F.floor((n + 1) * (k + 1) / (t + 2)).cast("bigint")))
        spread = F.sqrt(n * (k / F.greatest(t, F.lit(1.0))) * (1 - k / F.greatest(t, F.lit(1.0))))
        reach = (F.ceil(spread * 12) + 40).cast("bigint")
        return F.struct(
            n.alias("n"), k.alias("k"), (t - n - k).alias("rest"), mode.alias("mode"),
            F.least(high - mode, reach).alias("up"), F.least(mode - low, reach).alias("down"), x.u.alias("u"),
        )

    def steps(count):
        return F.when(count > 0, F.sequence(F.lit(1).cast("bigint"), count)).otherwise(F.array().cast("array<bigint>"))

    def up(f, j):  # from mode + j - 1 to mode + j
        x = (f.mode + j).cast("double")
        return (f.k - x + 1) * (f.n - x + 1) / (x * (f.rest + x))

    def down(f, j):  # from mode - j + 1 to mode - j
        x = (f.mode - j + 1).cast("double")
        return x * (f.rest + x) / ((f.k - x + 1) * (f.n - x + 1))

    def mass(f, count, ratio):
        def more(acc, j):
            return _let(acc.w * ratio(f, j), lambda w: F.struct(w.alias("w"), (acc.sum + w).alias("sum")))

        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        return F.aggregate(steps(count), start, more, lambda acc: acc.sum)

    def pick(f, count, ratio, sign, left, default):
        """The first value outwards at which the mass passes ``left``."""

        def more(acc, j):
            return _let(
                acc.w * ratio(f, j),
                lambda w: F.struct(
                    w.alias("w"),
                    (acc.left - w).alias("left"),
                    F.when(acc.found.isNull() & (acc.left < w), f.mode + j * sign).otherwise(acc.found).alias("found"),
                ),
            )

        start = F.struct(F.lit(1.0).alias("w"), left.alias("left"), F.lit(None).cast("bigint").alias("found"))
        return F.coalesce(F.aggregate(steps(count), start, more, lambda acc: acc.found), default)

    def draw(f):
        def with_mass(above):
            left = f.u * (1 + above + mass(f, f.down, down)) - 1
            return _let(
                left,
                lambda l: F.when(l < 0, f.mode)
                .when(l < above, pick(f, f.up, up, 1, l, f.mode))
                .otherwise(pick(f, f.down, down, -1, l - above, f.mode)),
            )

        return _let(mass(f, f.up, up), with_mass)

    facts = F.struct(total.alias("total"), good.alias("good"), drawn.alias("drawn"), u.alias("u"))
    return _let(_let(facts, with_facts), draw)


def _split(seats: Column, drawn: Column, *key: Column) -> Column:
    """How many of ``drawn`` rows take a seat in each shard, of ``seats`` per shard; array."""
    total = F.aggregate(seats, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def next_shard(acc, i):
        good = F.element_at(seats, i)
        return _let(
            _hypergeometric(acc.total, good, acc.drawn, _uniform(*key, i)),
            lambda x: F.struct(
                (acc.total - good).alias("total"), (acc.drawn - x).alias("drawn"), F.concat(acc.out, F.array(x)).alias("out")
            ),
        )

    start = F.struct(total.alias("total"), drawn.alias("drawn"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.size(seats)), start, next_shard, lambda acc: acc.out)


def communication_matrix(sizes: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """``sizes`` (block from 0, rows) to (block, seats): the rows a block sends to each shard, array.

    ``sizes`` must be a table (it is read once per level); it has at most 2 ** BLOCK_BITS rows, which
    is why the levels are broadcast.
    """
    totals = sizes.agg(F.sum("rows").alias("rows"), F.max("block").alias("last")).first()
    rows, bits = totals.rows or 0, (totals.last or 0).bit_length()
    seats = [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)]
    nodes = sizes.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("node"), F.array(*[F.lit(x).cast("bigint") for x in seats]).alias("seats")
    )
    for level in range(bits):
        left = (F.shiftright("block", bits - level - 1) % 2 == 0).cast("bigint")
        halves = sizes.groupBy(F.shiftright("block", bits - level).alias("node")).agg(F.sum(F.col("rows") * left).alias("left_rows"))
        drawn = nodes.join(F.broadcast(halves), "node").withColumn(
            "left_seats", _split(F.col("seats"), F.col("left_rows"), F.lit(seed), F.lit(level), F.col("node"))
        )
        children = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left_seats").alias("seats")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("seats", "left_seats", lambda a, b: a - b).alias("seats")),
        )
        nodes = drawn.select(F.explode(children).alias("child")).select("child.*")
    return nodes.withColumnRenamed("node", "block")


def shuffle_into_shards(rows: DataFrame, n_shards: int, seed: int = 0) -> DataFrame:
    """Add ``shard`` (from 0) and ``slot`` (gapless from 0 within the shard) to every row.

    Every assignment of rows to (shard, slot) is equally likely; shard sizes differ by one at most.
    Rows count one by one, so repeated rows, null ids and equal texts are spread like all others
    and no key is hot. An empty table gives an empty result. Columns named shard or slot are
    replaced.

    The rows are written once with a number of their own; draws are hashes of that number, so
    retried tasks draw alike. Only the numbers take part in the two permutations; the rows
    themselves move once, to meet their places.
    """
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    given = stage(rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.monotonically_increasing_id().alias("number")), "given")
    partition = F.shiftrightunsigned("number", 33)
    last = given.agg(F.max(partition)).first()[0] or 0
    fold = max(0, last.bit_length() - BLOCK_BITS)
    numbers = given.select("number", F.shiftright(partition, fold).alias("block"))
    sizes = stage(numbers.groupBy("block").agg(F.count("*").alias("rows")), "sizes")
    matrix = communication_matrix(sizes, n_shards, seed)

    # The local permutation: ranks within the block, cut at the running sums of its row of the matrix.
    local = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "number"), "number")
    ranked = numbers.withColumn("rank", F.row_number().over(local) - 1)
    ends = F.transform("seats", lambda x, i: F.aggregate(F.slice("seats", 1, i + 1), F.lit(0).cast("bigint"), lambda a, y: a + y))
    shard = F.size(F.filter("ends", lambda end: end <= F.col("rank")))
    key = F.xxhash64(F.lit(seed), F.lit("shard"), "number")
    sent = ranked.join(matrix.select("block", ends.alias("ends")), "block").select("number", shard.alias("shard"), key.alias("key"))
    # The shard's permutation is the order of the keys; leading bits of the key cut it into buckets.
    per_shard = (sizes.agg(F.sum("rows")).first()[0] or 0) // n_shards
    bits = min(BUCKET_BITS, (per_shard // ROWS_PER_BUCKET).bit_length())
    sent = stage(sent.withColumn("bucket", F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("bigint")), "sent")
    counts = sent.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("key", "number")
    placed = (
        sent.withColumn("rank", F.row_number().over(within) - 1)
        .join(starts, ["shard", "bucket"])
        .select("number", F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("rank")).alias("slot"))
    )
    return given.join(placed, "number").select("row.*", "shard", "slot")
