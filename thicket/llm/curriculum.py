"""Mixing sources to target weights along a time-varying curriculum; DataFrame expressions only.

Every source has a weight schedule, a piecewise-linear function of training
time t in [0, 1].  Its integral from 0 to t is the source's cumulative token
demand.  A document copy takes the stretch [x, x + size) of its source's
supply, in an order dealt by a keyed hash; the demand curve, inverted at the
stretch's middle, gives the training position, and the mix is range-sorted by
position.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.scratch import stored

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Curriculum:
    """weights: dealt to the sources in code-point order (null last), repeating.
    share: size of the mix as a share of all sizes.  most: no source gives more
    than so many times its size.  ramps: a weight's factor at t = 0 and t = 1,
    dealt likewise; between them it is linear and its mean is scaled to 1, so
    that a schedule moves tokens in time and not between sources.  buckets: the
    parts a source's order is cut into, each summed and ordered on its own."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    most: float = 2.0
    ramps: tuple[tuple[float, float], ...] = field(default=((1.0, 1.0), (0.5, 1.5), (1.5, 0.5)))
    seed: int = 7
    buckets: int = 4096


def targets(sizes: list[tuple[object, int]], plan: Curriculum) -> list[tuple[object, int, float, float]]:
    """(source, size, target, ramp number) for (source, size) in weight order: shares by weight, excess over the cap dealt again by weight until none is above."""
    n = len(plan.weights)
    weight = [plan.weights[i % n] for i in range(len(sizes))]
    cap = [plan.most * s for _, s in sizes]
    got, left, open_ = [0.0] * len(sizes), plan.share * sum(s for _, s in sizes), sum(weight)
    # those that reach their cap first are taken first; what is left goes to the others by weight
    for i in sorted(range(len(sizes)), key=lambda i: cap[i] / weight[i]):
        got[i] = min(cap[i], left * weight[i] / open_)
        left, open_ = left - got[i], open_ - weight[i]
    return [(s, size, got[i], i % len(plan.ramps)) for i, (s, size) in enumerate(sizes)]


def _inverse(share: Column, ramp: Column, plan: Curriculum) -> Column:
    """The time by which a source has given this share of its tokens: the integral of a linear weight, inverted."""
    out = share
    for i, (a, b) in enumerate(plan.ramps):
        a, b = 2 * a / (a + b), 2 * b / (a + b)
        if abs(b - a) > 1e-12:  # a t + (b - a) t^2 / 2 = share
            root = (F.sqrt(F.greatest(F.lit(0.0), F.lit(a * a) + F.lit(2 * (b - a)) * share)) - a) / (b - a)
            out = F.when(ramp == i, root).otherwise(out)
    return out


def _named(docs: DataFrame, plan: Curriculum) -> DataFrame:
    """docs with two hashes, _a and _b, that name a row by id, source and whole text, nulls apart."""
    parts = [F.col(c) for c in ("doc_id", "source", "text")] + [F.col(c).isNull() for c in ("doc_id", "source", "text")]
    return docs.withColumn("_a", F.xxhash64(F.lit(plan.seed), *parts)).withColumn("_b", F.xxhash64(F.lit(~plan.seed), *parts))


def placed(docs: DataFrame, plan: Curriculum = Curriculum()) -> DataFrame:
    """What the mix takes: for each distinct (doc_id, source, text) its _a, _b, doc_id, rows (how many rows say so), size, source_size, target, taken and copies array<struct<copy, words, position>>.

    Sizes are numbers of words (null text: 0).  A source gives each document
    floor(target / size) whole copies, and one more to the documents first in a
    keyed order until its target is met; the last of these is taken if that ends
    nearer the target.  So no document gives over ceil(most) times its words,
    and a source's sum is within half a document, with its repeats, of its
    target.  Equal rows get the same copies and reruns agree.  A null source is
    a source of its own; a document without words is taken once, with 0 words;
    an empty table gives an empty mix.  Other columns are not read.

    A source's order is cut into hash buckets, summed first, so that a source
    with a third of all rows is ordered in many tasks, never in one.
    """
    own = docs.select("doc_id", "source", "text")
    sized = _named(own, plan).select("doc_id", "source", "_a", "_b", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    light = stored(sized.groupBy("_a", "_b").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("size").alias("size"), F.count("*").alias("rows")).withColumn("bucket", F.pmod(F.col("_b"), F.lit(plan.buckets)).cast("int")))
    parts = light.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("rows")).alias("part"))
    sums = [(r[0], int(r[1])) for r in parts.groupBy("source").agg(F.sum("part")).collect()]
    table = targets(sorted(sums, key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be"))), plan)
    wanted = docs.sparkSession.createDataFrame([(s, n, float(t), int(r)) for s, n, t, r in table], "source string, source_size long, target double, ramp int")
    before = parts.join(wanted, parts["source"].eqNullSafe(wanted["source"])).select(parts["source"], "bucket", "source_size", "target", "ramp", F.coalesce(F.sum("part").over(Window.partitionBy(parts["source"]).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = Window.partitionBy("source", "bucket").orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1)
    within = light.withColumn("within", F.coalesce(F.sum(F.col("size") * F.col("rows")).over(inner), F.lit(0)))
    out = within.alias("p").join(before.alias("b"), F.expr("p.source <=> b.source and p.bucket = b.bucket")).select("p.*", "source_size", "target", "ramp", (F.col("within") + F.col("before")).alias("at"))
    out = out.withColumn("whole", F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))))
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    more = F.col("at") + F.col("size") * F.col("rows") / 2 <= rest
    out = out.withColumn("n", F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("whole") + more.cast("int")).cast("int"))

    def copy(c: Column) -> Column:
        share = (c * F.col("source_size") + F.col("at") + F.col("size") / 2) / F.greatest(F.col("target"), F.lit(1.0))
        return F.struct(c.alias("copy"), F.col("size").alias("words"), _inverse(F.least(F.lit(1.0), share), F.col("ramp"), plan).alias("position"))

    copies = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.col("n") - 1), copy)).otherwise(F.array().cast("array<struct<copy:int,words:bigint,position:double>>"))
    return out.select("_a", "_b", "doc_id", "rows", "size", "source_size", "target", (F.col("n") * F.col("size")).alias("taken"), copies.alias("copies"))


def report(docs: DataFrame, plan: Curriculum = Curriculum(), most: int = 4096) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_position), a row for each row of docs, range-sorted by the training position of the first copy; rows of which the mix takes nothing come first."""
    first = placed(docs, plan).withColumn("first_position", F.try_element_at("copies", F.lit(1))["position"])
    # rows that repeat very often are spelled out in several tasks
    parts = first.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / most)))).drop("copies")
    order = ["first_position", "doc_id", "_a", "_part"]
    own = parts.repartitionByRange(*order).sortWithinPartitions(*order)
    return own.withColumn("_row", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.col("rows") - F.col("_part") * most)))).select("doc_id", "size", "source_size", "target", "taken", "first_position")


def mixed(docs: DataFrame, plan: Curriculum = Curriculum()) -> DataFrame:
    """The mix itself: docs' columns, whatever they are, a row for each copy taken, range-sorted by training position.  Texts are shuffled once to meet their plan and once to be sorted."""
    names = [f"`{c.replace('`', '``')}`" for c in docs.columns]
    left = _named(docs.select("doc_id", "source", "text", F.struct(*names).alias("_row")), plan).select("_row", "_a", "_b")
    out = left.join(placed(docs, plan).select("_a", "_b", "copies"), ["_a", "_b"]).select("_row", F.explode("copies").alias("_copy"))
    return out.repartitionByRange("_copy.position", "_row.doc_id").sortWithinPartitions("_copy.position", "_row.doc_id").select(*[F.col(f"_row.{n}") for n in names])
