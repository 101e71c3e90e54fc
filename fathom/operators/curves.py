"""Rings as tables (k, ring_id, i, x, y): cyclic neighbours, metrics, smoothing, densifying, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom import model as M
from fathom.operators.graph import dealt_join
from fathom.shared import Tables

KEYS = ("k", "ring_id")
#: Sides of the longest ring whose sides are compared without cells.
FEW_SIDES = 32


def _ordered(keys: tuple[str, ...] = KEYS):
    return Window.partitionBy(*keys).orderBy("i")


def with_neighbours(rings: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Adds the previous and next point of each, round the ring."""
    w = _ordered(keys)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = lambda c: F.last(c).over(whole)
    first = lambda c: F.first(c).over(whole)
    return rings.withColumns({"px": F.coalesce(F.lag("x").over(w), last("x")), "py": F.coalesce(F.lag("y").over(w), last("y")), "nx": F.coalesce(F.lead("x").over(w), first("x")), "ny": F.coalesce(F.lead("y").over(w), first("y"))})


def metrics(rings: DataFrame) -> DataFrame:
    """Points, perimeter, signed area and roughness (root mean square of second differences) of each ring."""
    r = with_neighbours(rings)
    sx, sy = F.col("px") - F.col("x") * 2.0 + F.col("nx"), F.col("py") - F.col("y") * 2.0 + F.col("ny")
    step = F.sqrt((F.col("nx") - F.col("x")) * (F.col("nx") - F.col("x")) + (F.col("ny") - F.col("y")) * (F.col("ny") - F.col("y")))
    # Over four, so that a square of side 2 has the roughness of its corners' offset from their neighbours' middle.
    return r.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum(step).alias("perimeter"), (F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")) / 2).alias("area"), F.sqrt(F.avg((sx * sx + sy * sy) / 4)).alias("roughness"))


def smooth_pass(rings: DataFrame, factor: float) -> DataFrame:
    """Move each point by a factor of its offset from its neighbours' middle."""
    r = with_neighbours(rings)
    move = lambda c: F.col(c) + ((F.col(f"p{c}") + F.col(f"n{c}")) / 2.0 - F.col(c)) * factor
    return r.withColumns({"x": move("x"), "y": move("y")}).drop("px", "py", "nx", "ny")


def taubin(rings: DataFrame, iterations: int, lam: float = M.TAUBIN_LAMBDA, mu: float = M.TAUBIN_MU) -> DataFrame:
    """Low-pass smoothing that doesn't shrink: a step in and a step out, so many times. Each is a window; the plan grows with them."""
    for _ in range(iterations):
        rings = smooth_pass(smooth_pass(rings, lam), mu)
    return rings


def chaikin(rings: DataFrame) -> DataFrame:
    """One pass of corner cutting: each side gives its points at a quarter and three quarters."""
    r = with_neighbours(rings)
    at = lambda t, j: F.struct((F.col("i") * 2 + j).alias("i"), (F.col("x") * (1.0 - t) + F.col("nx") * t).alias("x"), (F.col("y") * (1.0 - t) + F.col("ny") * t).alias("y"))
    return r.select(*KEYS, F.explode(F.array(at(0.25, 0), at(0.75, 1))).alias("p")).select(*KEYS, "p.*")


def densify(rings: DataFrame, step: float) -> DataFrame:
    """Points at most ``step`` apart along every side, its end left out."""
    r = with_neighbours(rings)
    length = F.sqrt((F.col("nx") - F.col("x")) * (F.col("nx") - F.col("x")) + (F.col("ny") - F.col("y")) * (F.col("ny") - F.col("y")))
    parts = F.greatest(F.lit(1), F.ceil(length / step).cast("int"))
    d = r.withColumn("parts", parts).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    t = F.col("j") / F.col("parts").cast("double")
    return d.select(*KEYS, "i", "j", (F.col("x") + (F.col("nx") - F.col("x")) * t).alias("x"), (F.col("y") + (F.col("ny") - F.col("y")) * t).alias("y"))


def _straight() -> Column:
    ax, ay, bx, by = F.col("x") - F.col("px"), F.col("y") - F.col("py"), F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    return (ax * by - ay * bx == 0) & (ax * bx + ay * by > 0)


def collinear_free(rings: DataFrame) -> DataFrame:
    """Without points that lie exactly on the way between their neighbours, until none is left.

    A pass takes all of them at once: where several follow each other, all lie on one line and their ends keep their directions. With exact
    coordinates that is the end; where rounding makes new ones, passes go on.
    """
    with Tables(rings.sparkSession) as tables:
        while True:
            near = tables.written(with_neighbours(rings).withColumn("straight", _straight()), "straight")
            left = near.where("not straight").select(*rings.columns)
            if near.where("straight").isEmpty():
                return tables.kept(left, "collinear-free")
            rings = left


def simplified(rings: DataFrame, tolerance: float) -> DataFrame:
    """Points that Douglas and Peucker keep of closed rings, from each one's first point round to it, for rings of any length.

    All open segments are split at once: a round finds the farthest point of each by a maximum that is combined map-side, keeps
    it if it is off by more than the tolerance, and deals the others to the halves. Of equally far ones the first counts. Comparisons are of
    squares without a division, exact for integer coordinates. Rounds are as many as the deepest ring has levels.
    """
    w = _ordered()
    first = F.first(F.struct("x", "y")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    each = rings.select(*KEYS, "i", "x", "y", (F.row_number().over(w) - 1).alias("at"), first.alias("a"))
    with Tables(rings.sparkSession) as tables:
        begun = each.select(F.struct(*KEYS, F.lit(0).alias("from")).alias("segment"), "i", "at", F.struct("x", "y").alias("p"), "a", F.col("a").alias("b"))
        begun = tables.written(begun, "begun")
        kept, open_ = begun.where("at = 0").select("segment", "i", "p"), begun.where("at > 0")
        dx, dy = (F.col(f"b.{c}") - F.col(f"a.{c}") for c in "xy")
        px, py = (F.col(f"p.{c}") - F.col(f"a.{c}") for c in "xy")
        length, cross = dx * dx + dy * dy, px * dy - py * dx
        off = F.when(length == 0, px * px + py * py).otherwise(cross * cross)
        enough = F.when(length == 0, F.lit(1.0)).otherwise(length) * F.lit(tolerance * tolerance)
        while not open_.isEmpty():
            rated = open_.withColumns({"off": off, "enough": enough})
            far = rated.groupBy("segment").agg(F.max_by(F.struct("i", "at", "p", "off", "enough"), F.struct(F.col("off"), -F.col("at"))).alias("far"), F.count(F.lit(1)).alias("n"))
            far = tables.written(far.where("far.off > far.enough"), "farthest")
            kept = kept.union(far.select("segment", "far.i", "far.p"))
            total = far.agg(F.sum("n")).first()[0]
            if not total:
                break
            met = dealt_join(open_, far, "segment", F.xxhash64("at"), total).where("at != far.at")
            before = F.col("at") < F.col("far.at")
            segment = F.struct(*(F.col(f"segment.{k}").alias(k) for k in KEYS), F.when(before, F.col("segment.from")).otherwise(F.col("far.at")).alias("from"))
            halves = met.select(segment.alias("segment"), "i", "at", "p", F.when(before, F.col("a")).otherwise(F.col("far.p")).alias("a"), F.when(before, F.col("far.p")).otherwise(F.col("b")).alias("b"))
            open_ = tables.written(halves, "halves")
        return tables.kept(kept.select(*(F.col(f"segment.{k}").alias(k) for k in KEYS), "i", "p.x", "p.y"), "simplified")


def crossings(rings: DataFrame, cell: float) -> DataFrame:
    """(keys, a, b): places of the sides, a < b, of a ring that meet though they are no neighbours. A side begins at the point of its place.

    Sides of a ring of up to ``FEW_SIDES`` are compared as they stand together, those of longer ones in square cells that their boxes cover. The places of a ring's points need not follow each other.
    """
    longest = rings.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    w = _ordered()
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    side = rings.select(*KEYS, "i", "x", "y", (F.row_number().over(w) - 1).alias("at"), F.count(F.lit(1)).over(Window.partitionBy(*KEYS)).alias("size"), after("x").alias("nx"), after("y").alias("ny"))
    shape = F.struct("i", "at", "size", "x", "y", "nx", "ny")
    turn = lambda p, q: F.signum((F.col(f"{p}.nx") - F.col(f"{p}.x")) * (q[1] - F.col(f"{p}.y")) - (F.col(f"{p}.ny") - F.col(f"{p}.y")) * (q[0] - F.col(f"{p}.x")))
    ends = lambda p: ((F.col(f"{p}.x"), F.col(f"{p}.y")), (F.col(f"{p}.nx"), F.col(f"{p}.ny")))
    apart = lambda p, q: turn(p, ends(q)[0]) * turn(p, ends(q)[1]) > 0
    boxed = lambda n, m: (F.greatest(f"a.{n}", f"a.{m}") >= F.least(f"b.{n}", f"b.{m}")) & (F.greatest(f"b.{n}", f"b.{m}") >= F.least(f"a.{n}", f"a.{m}"))
    meet = lambda d: d.where("a.at + 1 < b.at and b.at - a.at < a.size - 1").where(boxed("x", "nx") & boxed("y", "ny") & ~apart("a", "b") & ~apart("b", "a")).select(*KEYS, F.col("a.i").alias("a"), F.col("b.i").alias("b"))
    together = side.where(F.col("size") <= FEW_SIDES).groupBy(*KEYS).agg(F.collect_list(shape).alias("sides"))
    met = meet(together.select(*KEYS, "sides", F.explode("sides").alias("a")).select(*KEYS, "a", F.explode("sides").alias("b")))
    if longest <= FEW_SIDES:
        return met
    over = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell)))
    placed = side.where(F.col("size") > FEW_SIDES).withColumn("cx", over("x", "nx")).withColumn("cy", over("y", "ny"))
    a, b = (placed.select(*KEYS, "cx", "cy", shape.alias(n)) for n in "ab")
    return met.union(meet(a.join(b.hint("merge"), [*KEYS, "cx", "cy"])).distinct())


def simplified_valid(rings: DataFrame, tolerance: float) -> DataFrame:
    """simplified(), with points put back until no ring meets itself that has points left to put back.

    Each round gives every side that meets another the farthest of the points it left out, and looks at the rings again that got some. A ring that met itself from the begin ends as it was there.
    """
    with Tables(rings.sparkSession) as tables:
        kept = tables.written(simplified(rings, tolerance), "kept")
        length = F.sqrt((F.col("nx") - F.col("x")) ** 2 + (F.col("ny") - F.col("y")) ** 2)
        cell = 2.0 * (with_neighbours(kept).agg(F.avg(length)).first()[0] or 0.0) or 1.0
        now, keys = kept, list(KEYS)
        while True:
            bad = tables.written(crossings(now, cell).select(*KEYS, F.explode(F.array("a", "b")).alias("begin")).distinct(), "crossing")
            if bad.isEmpty():
                break
            which = bad.select(*KEYS).distinct().hint("merge")
            now = now.join(which, keys, "left_semi")
            w = _ordered()
            spans = with_neighbours(now).withColumn("end", F.lead("i").over(w)).select(*KEYS, F.col("i").alias("begin"), "end", "x", "y", "nx", "ny").join(bad.hint("merge"), [*keys, "begin"])
            left = rings.join(which, keys, "left_semi").join(now.select(*KEYS, "i").hint("merge"), [*keys, "i"], "left_anti")
            # The last side runs round to the first point.
            within = left.select(*KEYS, "i", F.struct("x", "y").alias("p")).join(spans.hint("merge"), keys).where("i > begin and (end is null or i < end)")
            dx, dy, px, py = F.col("nx") - F.col("x"), F.col("ny") - F.col("y"), F.col("p.x") - F.col("x"), F.col("p.y") - F.col("y")
            far = F.struct(F.abs(px * dy - py * dx), px * px + py * py, -F.col("i"))
            back = tables.written(within.groupBy(*KEYS, "begin").agg(F.max_by(F.struct("i", "p"), far).alias("m")).select(*KEYS, "m.i", "m.p.x", "m.p.y"), "back")
            if back.isEmpty():
                break
            kept = kept.unionByName(back)
            now = tables.written(now.join(back.select(*KEYS).distinct().hint("merge"), keys, "left_semi").unionByName(back), "again")
        return tables.kept(kept, "simplified")


def category_area(rings: DataFrame, by: str) -> DataFrame:
    """Area within the rings of each category, by the shoelace formula; rings are taken one by one, whatever way they turn."""
    cross = F.col("x") * F.col("ny") - F.col("nx") * F.col("y")
    keys = list(dict.fromkeys([by, *KEYS]))
    each = with_neighbours(rings).groupBy(*keys).agg(F.abs(F.sum(cross)).alias("double"))
    return each.groupBy(by).agg((F.sum("double") / 2).alias("area"))


def point_on_ring(rings: DataFrame, fraction: Column) -> DataFrame:
    """Point and readable angle at a fraction of each ring's length, by running sums."""
    r = with_neighbours(rings)
    dx, dy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    r = r.withColumn("seg", F.sqrt(dx * dx + dy * dy))
    w = _ordered()
    r = r.withColumns({"upto": F.sum("seg").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "total": F.sum("seg").over(Window.partitionBy(*KEYS)), "f": fraction})
    hit = r.where("upto >= f * total").groupBy(*KEYS).agg(F.min_by(F.struct("x", "y", "nx", "ny", "seg", "upto", "total", "f"), "i").alias("s")).select(*KEYS, "s.*")
    t = (F.col("f") * F.col("total") - (F.col("upto") - F.col("seg"))) / (F.col("seg") + 1e-12)
    turn = F.degrees(F.atan2(F.col("ny") - F.col("y"), F.col("nx") - F.col("x")))
    angle = F.when(turn > 90, turn - 180).when(turn < -90, turn + 180).otherwise(turn)
    return hit.select(*KEYS, (F.col("x") * (F.lit(1.0) - t) + F.col("nx") * t).alias("x"), (F.col("y") * (F.lit(1.0) - t) + F.col("ny") * t).alias("y"), angle.alias("angle"), "total")


def labels(rings: DataFrame, width: float, height: float, most: int = 2, longest: int = 8, least: float = 180.0, margin: float = 15.0) -> DataFrame:
    """Label places: of the longest rings of each k, up to ``most`` whose point lies off the border.

    The place on a ring depends on how many were accepted before it: 0.46 of the length for the first,
    0.72 for the next. Both are computed and the choice is a fold over the few candidates.
    """
    size = metrics(rings).where(F.col("perimeter") >= least)
    w = Window.partitionBy("k").orderBy(F.desc(F.round("perimeter", 6)), "ring_id")
    ranked = size.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= longest).select(*KEYS, "rank")
    some = rings.join(ranked.select(*KEYS), list(KEYS), "left_semi")
    inside = F.col("x").between(margin, width - margin) & F.col("y").between(margin, height - margin)
    a = point_on_ring(some, F.lit(0.46)).select(*KEYS, F.struct(inside.alias("ok"), "x", "y", "angle").alias("a"))
    b = point_on_ring(some, F.lit(0.72)).select(*KEYS, F.struct(inside.alias("ok"), "x", "y", "angle").alias("b"))
    each = ranked.join(a, list(KEYS)).join(b, list(KEYS)).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("rank", "ring_id", "a", "b"))).alias("cs"))
    kind = "array<struct<ring_id: bigint, x: double, y: double, angle: double>>"

    def step(acc: Column, c: Column) -> Column:
        p = F.when(F.size(acc) == 0, c["a"]).otherwise(c["b"])
        return F.when((F.size(acc) < most) & p["ok"], F.concat(acc, F.array(F.struct(c["ring_id"].alias("ring_id"), p["x"].alias("x"), p["y"].alias("y"), p["angle"].alias("angle"))))).otherwise(acc)

    return each.select("k", F.explode(F.aggregate("cs", F.array().cast(kind), step)).alias("l")).select("k", "l.*")


def svg_paths(rings: DataFrame, digits: int = 3) -> DataFrame:
    """A closed SVG path for each ring."""
    f = f"%.{digits}f,%.{digits}f"
    pts = rings.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("i", F.format_string(f, "x", "y").alias("p")))).alias("ps"))
    return pts.select(*KEYS, F.concat(F.lit("M "), F.array_join(F.transform("ps", lambda p: p["p"]), " L "), F.lit(" Z")).alias("d"))


def smoothing_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """By k: vertex-weighted roughness before and after, and the largest relative change of area."""
    b, a = metrics(before), metrics(after).select(*KEYS, F.col("roughness").alias("r2"), F.col("area").alias("a2"))
    change = F.abs(F.col("a2") - F.col("area")) / F.greatest(F.abs("area"), F.lit(1e-9))
    return b.join(a, list(KEYS)).groupBy("k").agg((F.sum(F.col("roughness") * F.col("n")) / F.sum("n")).alias("before"), (F.sum(F.col("r2") * F.col("n")) / F.sum("n")).alias("after"), F.max(change).alias("area_change"))
