"""Exact k-nearest joins as equi-joins on cells, for the sphere or the degree plane.

How a probe finds its neighbours without comparing all rows of a day:

1. rows collapse to the finest cells (about 150 m) with their pool counts;
2. a probe cell climbs to the first coarser cell that holds enough pool rows,
   which bounds how far its k-th neighbour can be;
3. the bound is tightened from that cell's own sub-cells, then again from the
   finest cells, and only cells closer than the bound are paired with the probe;
4. probe and pool rows of the surviving cell pairs are compared and ranked.

Steps 1-3 touch cell counts only. Copies at one place are reduced to the first
k (plus one for self-exclusion) by tie-break, which cannot change any answer.

Where the same places are probed in many groups (sensors by day), distinct places
alone say which pool places can serve them. Probes and pool rows meet once in tiles
of a few hundred neighbouring places and one group; a pool row goes to the tiles
whose places can need it (about twice), and a probe keeps its k nearest there. It is
settled when the k-th lies within the reach of its place. Probes that are not (few
of the places around have a row that day) look farther. Both ways are exact.

Coarse cells are few but hold every probe, so the climb's join is salted there.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spatiofuse.constants import KM_PER_DEGREE
from spatiofuse.functions import cells as G
from spatiofuse.operators import quadtree
from spatiofuse.session import cut_lineage

FINEST = 18
#: Levels of the climb: two halvings apart.
LEVELS = list(range(FINEST, -1, -2))
#: Cells of these levels (1.4 degrees and more) are salted so many times.
COARSE, SALTS = 8, 16
#: Pairs up to which the few probes that their lists leave open meet all rows of their group.
FEW_PAIRS = 2_000_000
#: Probes per distinct place from which tiles pay; probe places of a tile; and the most places that a reach is widened to.
REPEATED, TILE_PLACES, FARTHEST = 3, 1024, 4096
#: Few probes are sent to the rows of their groups.
FEW_PROBES = 100_000


def places_around(k: int) -> int:
    """Places within reach of a probe that looks for ``k`` rows: some have none that day, or none that is eligible."""
    return 3 * k + 8


def _size(level) -> Column:
    return F.lit(360.0) / F.pow(F.lit(2.0), level)


def _count(level) -> Column:
    return F.pow(F.lit(2.0), level).cast("long")


def _finest(df: DataFrame, lat: str, lon: str, i: str, j: str) -> DataFrame:
    s = F.lit(360.0 / 2**FINEST)
    return df.withColumns({i: G.lat_index(lat, s), j: G.lon_index(lon, s, F.lit(2**FINEST).cast("long"))})


def _ancestor(index: str, level: str = "m") -> Column:
    return F.floor(F.col(index) / F.pow(F.lit(2.0), F.lit(FINEST) - F.col(level))).cast("long")


def _finer(level: str) -> Column:
    """Level four halvings below."""
    return F.least(F.col(level) + 4, F.lit(FINEST))


def _at_levels(df: DataFrame, i: str, j: str) -> DataFrame:
    """Explode a finest cell over its ancestors (``m`` is the level)."""
    return (df.withColumn("m", F.explode(F.array(*[F.lit(x) for x in LEVELS])))
            .withColumns({"ai": _ancestor(i), "aj": _ancestor(j)}))


def nearest(queries: DataFrame, pool: DataFrame, k: int, *, on: tuple[str, ...] = ("date",),
            metric: str = "haversine", order: tuple[str, ...] = ("id",), not_same: str | None = None) -> DataFrame:
    """The ``k`` pool rows nearest to each distinct probe.

    ``queries``: distinct ``on`` + lat, lon (+ ``not_same``). ``pool``: ``on`` +
    lat, lon, the ``order`` columns (tie-break, unique) and any payload. With
    ``not_same`` a pool row whose value of that column equals the probe's is not
    eligible. Returns the probe columns, the pool columns prefixed ``p_``,
    ``distance`` and ``rank`` (1 = nearest). A probe with fewer than ``k``
    eligible rows gets them all; one with none gets no row.
    """
    probe = [*on, "lat", "lon"] + ([not_same] if not_same else [])
    lists = nearest_lists(queries, pool, k, on=on, metric=metric, order=order, not_same=not_same)
    carried = [F.col(f"_e.p_{c}") for c in pool.columns if c not in on]
    return lists.select(*probe, F.posexplode("_near").alias("_at", "_e")).select(*probe, *carried, "_e.distance", (F.col("_at") + 1).alias("rank"))


def nearest_lists(queries: DataFrame, pool: DataFrame, k: int, *, on: tuple[str, ...] = ("date",),
                  metric: str = "haversine", order: tuple[str, ...] = ("id",), not_same: str | None = None) -> DataFrame:
    """``nearest`` with a probe's rows in one array ``_near`` of structs, nearest first: no row is shuffled again to bring them together.

    A probe without any eligible row may have an empty array or no row.
    """
    side = [not_same] if not_same else []
    known = [F.col(c).isNotNull() for c in ("lat", "lon", *on)]
    queries = cut_lineage(queries.filter(reduce(and_, known)).select(*on, "lat", "lon", *side))  # both are read by several steps
    pool = pool.filter(reduce(and_, known))
    ties = W.partitionBy(*on, "lat", "lon", *side).orderBy(*order)
    pool = cut_lineage(pool.withColumn("_copy", F.row_number().over(ties)).filter(F.col("_copy") <= k).drop("_copy"))
    options = {"metric": metric, "order": order, "not_same": not_same}
    if on:
        size = queries.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.struct("lat", "lon")).alias("places")).first()
        if size["n"] >= REPEATED * size["places"]:
            return _by_places(queries, pool, k, on=on, **options)
    return _packed(_by_leaves(queries, pool, k, on=on, **options), pool, on, order, side)


def _entry(pool: DataFrame, on: tuple[str, ...], order: tuple[str, ...]) -> list[str]:
    """Pool columns of a list's entry after its distance: the tie-break first."""
    return [f"p_{c}" for c in (*order, *[c for c in pool.columns if c not in on and c not in order])]


def _packed(found: DataFrame, pool: DataFrame, on: tuple[str, ...], order: tuple[str, ...], side: list[str]) -> DataFrame:
    """Ranked rows as one list for each probe."""
    entry = F.struct("distance", *_entry(pool, on, order))
    return found.groupBy(*on, "lat", "lon", *side).agg(F.sort_array(F.collect_list(entry)).alias("_near"))  # at most ``k`` rows


def _by_places(queries: DataFrame, pool: DataFrame, k: int, *, on: tuple[str, ...], metric: str,
               order: tuple[str, ...], not_same: str | None) -> DataFrame:
    """``nearest_lists`` in tiles of neighbouring places, with a wider reach for the probes that theirs leaves open."""
    side = [not_same] if not_same else []
    probe, around, out, rows = [*on, "lat", "lon", *side], places_around(k), None, pool
    options = {"on": on, "metric": metric, "order": order, "not_same": not_same}
    while True:
        found = _in_tiles(queries, rows, k, around, **options) if around <= FARTHEST else None
        if found is None:  # too many places for one tree, or few rows around
            part = _packed(_by_leaves(queries, rows, k, **options), pool, on, order, side)
            return part if out is None else out.unionByName(part)
        done = found.filter("_settled").select(*probe, "_near")
        out = done if out is None else out.unionByName(done)
        queries = found.filter("NOT _settled").select(*probe)
        asked = queries.groupBy(*on).agg(F.count(F.lit(1)).alias("nq"))
        held = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("np"))
        size = asked.join(held, list(on), "left").agg(F.sum("nq").alias("n"), F.sum(F.col("nq") * F.coalesce("np", F.lit(0))).alias("pairs")).first()
        if not size["n"]:
            return out
        queries = cut_lineage(queries)
        named = rows.select(*on, *[F.col(c).alias(f"p_{c}") for c in pool.columns if c not in on])
        if size["pairs"] <= FEW_PAIRS:
            few = (F.broadcast(queries) if size["n"] <= FEW_PROBES else queries).join(named, list(on))
            return out.unionByName(_packed(_ranked(few, probe, k, metric, order, not_same), pool, on, order, side))
        rows = cut_lineage(rows.join(queries.select(*on).distinct(), list(on), "left_semi"))
        around *= 8


def _in_tiles(queries: DataFrame, pool: DataFrame, k: int, around: int, *, on: tuple[str, ...], metric: str,
              order: tuple[str, ...], not_same: str | None) -> DataFrame | None:
    """Probe columns, ``_near`` and ``_settled``: whether no pool row outside a probe's tile can be among its ``k``; None without a tree."""
    tree = quadtree.build(pool.select("lat", "lon").distinct(), [], "lat", "lon", metric)
    if tree is None:
        return None
    shared = queries.sparkSession.sparkContext.broadcast(tree)
    probe = [*on, "lat", "lon"] + ([not_same] if not_same else [])
    home = queries.select("lat", "lon").distinct().select("lat", "lon", quadtree.homes(shared, "lat", "lon", around).alias("_h")).select("lat", "lon", "_h.*")
    home = cut_lineage(home)
    parts = home.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE_PLACES)).alias("_n"))  # probes may crowd where few rows are
    home = cut_lineage(home.join(parts, "tile").withColumn("part", F.pmod(F.xxhash64("lat", "lon"), F.col("_n"))).drop("_n"))
    needed = cut_lineage(home.select("tile", "part", F.explode("leaves").alias("_leaf")).distinct())
    carried = _entry(pool, on, order)
    rows = pool.withColumn("_leaf", quadtree.leaf_column(shared, [], "lat", "lon"))
    rows = rows.select(*on, "_leaf", *[F.col(c[2:]).alias(c) for c in carried]).join(needed, "_leaf").drop("_leaf")
    asked = queries.join(home.select("lat", "lon", "tile", "part", F.col("reach").alias("_reach")), ["lat", "lon"])
    keep, keys = [*probe, "_reach"], ["tile", "part", *on]
    entry = T.StructType([T.StructField(c, pool.schema[c[2:]].dataType) for c in carried])
    schema = T.StructType([*[T.StructField(c, asked.schema[c].dataType) for c in keep], T.StructField("_near", T.ArrayType(entry))])
    pick = quadtree.picker(keep, carried, k, metric, not_same)
    met = asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(pick, schema)
    measured = F.transform("_near", lambda e: F.struct(G.distance(metric)("lat", "lon", e["p_lat"], e["p_lon"]).alias("distance"), *[e[c].alias(c) for c in carried]))
    met = met.withColumn("_near", F.slice(F.sort_array(measured), 1, k))
    whole = F.col("_reach") == float("inf")  # the tile has all there is
    settled = whole | ((F.size("_near") >= k) & (F.try_element_at("_near", F.lit(k))["distance"] < F.col("_reach")))
    return cut_lineage(met.select(*probe, "_near", F.coalesce(settled, F.lit(False)).alias("_settled")))


def _by_leaves(queries: DataFrame, pool: DataFrame, k: int, *, on: tuple[str, ...], metric: str,
               order: tuple[str, ...], not_same: str | None) -> DataFrame:
    """``nearest`` by the leaves of a count-balanced quadtree within each group of ``on``; by cells where its leaf table is too large to send."""
    tree = quadtree.build(pool, list(on), "lat", "lon", metric, not_same)
    if tree is None:
        return _by_cells(queries, pool, k, on=on, metric=metric, order=order, not_same=not_same)
    shared = queries.sparkSession.sparkContext.broadcast(tree)
    probe = [*on, "lat", "lon"] + ([not_same] if not_same else [])
    rows = pool.withColumn("_leaf", quadtree.leaf_column(shared, list(on), "lat", "lon"))
    rows = rows.select("_leaf", *[F.col(c).alias(f"p_{c}") for c in pool.columns if c not in on])
    asked = queries.select(*probe, quadtree.candidate_leaves(shared, list(on), "lat", "lon", k).alias("_leaves"))
    found = asked.withColumn("_leaf", F.explode("_leaves")).drop("_leaves").join(rows, "_leaf").drop("_leaf")
    return _ranked(found, probe, k, metric, order, not_same)


def _ranked(pairs: DataFrame, probe: list[str], k: int, metric: str, order: tuple[str, ...], not_same: str | None) -> DataFrame:
    """The ``k`` nearest eligible rows of each probe among candidate pairs."""
    if not_same:
        pairs = pairs.filter(~F.col(not_same).eqNullSafe(F.col(f"p_{not_same}")))
    ranked = W.partitionBy(*probe).orderBy("distance", *[f"p_{c}" for c in order])
    return (pairs.withColumn("distance", G.distance(metric)("lat", "lon", "p_lat", "p_lon"))
            .withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k))


def _by_cells(queries: DataFrame, pool: DataFrame, k: int, *, on: tuple[str, ...], metric: str,
              order: tuple[str, ...], not_same: str | None) -> DataFrame:
    """``nearest`` by cells within each group of ``on``; coordinates are not NULL and copies are at most ``k``."""
    on = list(on)
    scale = KM_PER_DEGREE if metric == "haversine" else 1.0
    dist = G.distance(metric)
    side = [not_same] if not_same else []
    probe = [*on, "lat", "lon", *side]

    pool = pool.select(*on, *[F.col(c).alias(f"p_{c}") for c in pool.columns if c not in on])
    pool = _finest(pool, "p_lat", "p_lon", "pi", "pj")
    queries = _finest(queries, "lat", "lon", "qi", "qj")

    # 1. finest-cell counts; with an exclusion also by its value
    p_side = [f"p_{not_same}"] if not_same else []
    p_cells = pool.groupBy(*on, "pi", "pj", *p_side).agg(F.count(F.lit(1)).alias("np"))
    q_cells = queries.select(*on, "qi", "qj", *side).distinct()

    # 2. coarsest-needed level: first ancestor with k eligible rows whatever the exclusion removes
    ancestors = _at_levels(p_cells, "pi", "pj")
    if not_same:
        by_side = ancestors.groupBy(*on, "m", "ai", "aj", *p_side).agg(F.sum("np").alias("np"))
        enough = by_side.groupBy(*on, "m", "ai", "aj").agg((F.sum("np") - F.max("np")).alias("np"))
    else:
        enough = ancestors.groupBy(*on, "m", "ai", "aj").agg(F.sum("np").alias("np"))
    coarse = F.col("m") <= COARSE
    enough = (enough.filter(F.col("np") >= k).select(*on, "m", "ai", "aj")
              .withColumn("_salt", F.explode(F.when(coarse, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))))
    climbed = _at_levels(q_cells, "qi", "qj").withColumn("_salt", F.when(coarse, F.pmod(F.hash("qi", "qj"), F.lit(SALTS))).otherwise(0))
    level = (climbed.join(enough, [*on, "m", "ai", "aj", "_salt"])
             .groupBy(*on, "qi", "qj", *side).agg(F.max("m").alias("m")))
    q_cells = (q_cells.join(level, [*on, "qi", "qj", *side], "left")
               .withColumn("m", F.coalesce("m", F.lit(0))))

    s_fine = 360.0 / 2**FINEST
    q_key = [*on, "qi", "qj", *side]
    q_lat_c, q_lon_c = F.col("q_clat"), F.col("q_clon")
    q_cells = q_cells.withColumns({"q_clat": G.lat_centre("qi", F.lit(s_fine)), "q_clon": G.lon_centre("qj", F.lit(s_fine))})
    eligible = F.lit(True)
    if not_same:
        eligible = ~F.col(not_same).eqNullSafe(F.col(f"p_{not_same}"))

    def centred(df: DataFrame, i: str, j: str, size: Column) -> DataFrame:
        """Precompute a cell's centre and half-diagonal, so that pairs only pay for one distance."""
        return df.withColumns({"c_lat": G.lat_centre(i, size), "c_lon": G.lon_centre(j, size),
                               "c_half": G.half_diagonal(size, metric)})

    def span() -> tuple[Column, Column]:
        """Smallest and largest distance between points of a probe cell and of a pool cell."""
        centre = dist(q_lat_c, q_lon_c, "c_lat", "c_lon")
        margin = G.half_diagonal(s_fine, metric) + F.col("c_half") + F.lit(1e-12)
        return centre - margin, centre + margin

    def kth(df: DataFrame) -> Column:
        """Upper bound on the k-th distance from cells of known count and largest distance."""
        seen = F.sum("np").over(W.partitionBy(*q_key).orderBy("far").rowsBetween(W.unboundedPreceding, W.currentRow))
        return F.when(seen >= k, F.col("far"))

    # 3a. first bound: the ancestor's children four halvings down
    children = (ancestors.withColumn("f", _finer("m"))
                .withColumns({"bi": _ancestor("pi", "f"), "bj": _ancestor("pj", "f")})
                .groupBy(*on, "m", "ai", "aj", "f", "bi", "bj", *p_side).agg(F.sum("np").alias("np")))
    children = centred(children, "bi", "bj", _size(F.col("f")))
    low, far = span()
    own = (q_cells.withColumns({"ai": _ancestor("qi"), "aj": _ancestor("qj")})
           .join(children, [*on, "m", "ai", "aj"]).filter(eligible)
           .withColumn("far", far))
    bound = own.withColumn("_k", kth(own)).groupBy(*q_key).agg(F.min("_k").alias("bound"))
    q_cells = (q_cells.join(bound, q_key, "left")
               .withColumn("m", F.when(F.col("bound").isNotNull(), F.col("m")).otherwise(0)))

    # 3b. cells of the ancestor's level within the bound, then their children, then finest cells within it
    size = _size(F.col("m"))
    reach = F.coalesce(F.col("bound"), F.lit(0.0))
    lat_pad = reach / F.lit(scale) + F.lit(s_fine)
    lat_edge = F.abs(q_lat_c) + F.lit(s_fine)
    lon_pad = (G.lon_reach(lat_edge, reach) if metric == "haversine" else reach) + F.lit(s_fine)
    i_lo, i_hi = G.lat_index(q_lat_c - lat_pad, size), G.lat_index(q_lat_c + lat_pad, size)
    j_lo = F.floor((q_lon_c - lon_pad + 180.0) / size).cast("long")
    j_hi = F.floor((q_lon_c + lon_pad + 180.0) / size).cast("long")
    around = (q_cells
              .withColumn("ai", F.explode(F.sequence(F.greatest(i_lo, F.lit(0)), F.greatest(i_hi, F.lit(0)))))
              .withColumn("_j", F.explode(F.sequence(j_lo, F.least(j_hi, j_lo + _count(F.col("m")) - 1))))
              .withColumn("aj", F.pmod("_j", _count(F.col("m")))).drop("_j"))
    unbounded = F.col("bound").isNull()
    near = (around.join(children, [*on, "m", "ai", "aj"]).filter(eligible)
            .filter(unbounded | (low <= F.col("bound")))
            .select(*q_key, "q_clat", "q_clon", "bound", F.col("f").alias("m"), F.col("bi").alias("ai"), F.col("bj").alias("aj"), *p_side))
    finest = centred(ancestors, "pi", "pj", F.lit(s_fine))
    fine = (near.join(finest, [*on, "m", "ai", "aj", *p_side])
            .withColumns({"low": low, "far": far}).filter(unbounded | (F.col("low") <= F.col("bound"))))
    tight = F.min("_k").over(W.partitionBy(*q_key))
    pairs = (fine.withColumn("_k", kth(fine)).withColumn("_tight", tight)
             .filter(F.col("_tight").isNull() | (F.col("low") <= F.col("_tight")))
             .select(*q_key, "pi", "pj", *p_side))

    # 4. rows of the surviving cell pairs
    ranked = W.partitionBy(*probe).orderBy("distance", *[f"p_{c}" for c in order])
    return (pairs.join(queries, [*on, "qi", "qj", *side])
            .join(pool, [*on, "pi", "pj", *p_side])
            .withColumn("distance", dist("lat", "lon", "p_lat", "p_lon"))
            .withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
            .drop("qi", "qj", "pi", "pj"))


def nearest_other(points: DataFrame, k: int, *, on: tuple[str, ...] = ("date",), metric: str = "haversine",
                  id_col: str = "id", payload: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` nearest *other* rows of each row of one table (self removed by id).

    Each place fetches k+1 candidates once; every row at the place drops itself
    and keeps the first k. Returns on + id, ``p_id``, payload, distance, rank.
    """
    on = list(on)
    pool = points.select(*on, "lat", "lon", F.col(id_col).alias("id"), *payload)
    lists = nearest_lists(points.select(*on, "lat", "lon").distinct(), pool, k + 1, on=tuple(on), metric=metric)
    mine = pool.select(*on, "lat", "lon", "id").join(lists, [*on, "lat", "lon"])
    others = F.slice(F.filter("_near", lambda e: e["p_id"] != F.col("id")), 1, k)
    carried = [F.col(f"_e.p_{c}") for c in pool.columns if c not in on]
    return (mine.select(*on, "lat", "lon", "id", F.posexplode(others).alias("_at", "_e"))
            .select(*on, "lat", "lon", "id", *carried, "_e.distance", (F.col("_at") + 1).alias("rank")))


def idw(neighbors: DataFrame, by: list[str], value: str, floor: float, power: float = 2.0) -> Column:
    """Inverse-distance weighted mean over ranked neighbours; NULL values weigh nothing."""
    w = F.when(F.col(value).isNotNull(), F.lit(1.0) / F.pow(F.greatest("distance", F.lit(floor)), F.lit(power)))
    return F.sum(w * F.col(value)) / F.sum(w)


def interpolate(queries: DataFrame, pool: DataFrame, columns: list[str], *, k: int, floor: float,
                on: tuple[str, ...] = ("date",), metric: str = "haversine",
                order: tuple[str, ...] = ("id",), not_same: str | None = None) -> DataFrame:
    """IDW of each column at each distinct probe; k=1 is the nearest value itself.

    Probes without an eligible pool row are absent from the result.
    """
    keys = [*on, "lat", "lon"] + ([not_same] if not_same else [])
    found = nearest(queries, pool, k, on=on, metric=metric, order=order, not_same=not_same)
    if k == 1:
        return found.select(*keys, *[F.col(f"p_{c}").alias(c) for c in columns])
    return found.groupBy(*keys).agg(*[idw(found, keys, f"p_{c}", floor).alias(c) for c in columns])


def nearest_cells(sites: DataFrame, products: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(product, lat, lon, clat, clon): the nearest cell (degree space) of each gridded product to each distinct site.

    ``products``: table and its latitude and longitude columns by name. All are
    matched by one join; the result is staged, as every product reads it.
    """
    sites = sites.select("lat", "lon").distinct()
    cells, probes = None, None
    for name, (table, lat, lon) in products.items():
        label = F.lit(name).alias("product")
        part = table.select(label, F.col(lat).alias("lat"), F.col(lon).alias("lon")).distinct()
        asked = sites.select(label, "lat", "lon")
        cells = part if cells is None else cells.unionByName(part)
        probes = asked if probes is None else probes.unionByName(asked)
    found = _by_leaves(*(cut_lineage(t.filter("lat IS NOT NULL AND lon IS NOT NULL")) for t in (probes, cells)), 1,
                      on=("product",), metric="degree", order=("lat", "lon"), not_same=None)
    return cut_lineage(found.select("product", "lat", "lon", F.col("p_lat").alias("clat"), F.col("p_lon").alias("clon")))


def with_nearest_cell(df: DataFrame, product: DataFrame, columns: list[str], cell_lat: str = "lat",
                      cell_lon: str = "lon", sites: DataFrame | None = None, mapped: DataFrame | None = None) -> DataFrame:
    """Left-join a gridded product by nearest cell (degree space) and exact date.

    The nearest cell is chosen among all cells of the whole product, so a cell
    without that day's value gives NULL rather than a farther cell's value.
    ``sites`` may give the distinct (lat, lon) of ``df`` from a cheaper table, so
    that a long plan is not evaluated twice; ``mapped`` their cells (lat, lon,
    clat, clon) where they are known.
    """
    wanted = [c for c in columns if c in product.columns and c not in df.columns]
    if not wanted:
        return df
    if mapped is None:
        mapped = nearest_cells(df if sites is None else sites, {"product": (product, cell_lat, cell_lon)})
    cells = mapped.select("lat", "lon", F.col("clat").alias("_clat"), F.col("clon").alias("_clon"))
    values = (product.select(F.col(cell_lat).alias("_clat"), F.col(cell_lon).alias("_clon"), "date", *wanted)
              .dropDuplicates(["_clat", "_clon", "date"]))
    joined = df.join(cells, ["lat", "lon"], "left").join(values, ["_clat", "_clon", "date"], "left").drop("_clat", "_clon")
    return joined.select(*df.columns, *wanted)
