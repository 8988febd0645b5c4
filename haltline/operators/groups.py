"""Stop groups: stops joined by parent links and by nearby stops of the same name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haltline.functions import haversine_m, normalize_name, usable_position
from haltline.functions.geo import EARTH_RADIUS_M
from haltline.operators.components import connected_components
from haltline.operators.indexes import stop_route_pairs
from haltline.schema import AGENCY_COLUMNS, GROUP_COLUMNS, ROUTE_COLUMNS, STOP_COLUMNS, Timetable
from haltline.session import cut_lineage, keep_table

MERGE_DISTANCE_M = 150.0
CELL_LAT, CELL_LON = 0.0015, 0.0025
TILES = 3
MEMBERS_PER_PART = 1_000
#: Calls of all stops are read where at least one stop in so many is asked for.
MOST_STOPS = 3
STATION = 1
#: Mean positions are cut to so many digits, 0.1 mm: sums of doubles depend on the order rows come in, and a border must not.
POSITION_DIGITS = 9


def _with_labels(stops: DataFrame, labels: DataFrame) -> DataFrame:
    """Stops with the label of their component; a stop without an edge labels itself."""
    return stops.join(
        labels.withColumnRenamed("node", "stop_id"), "stop_id", "left"
    ).withColumn("label", F.coalesce("label", "stop_id"))


def _parent_edges(stops: DataFrame) -> DataFrame:
    links = stops.filter(F.col("parent_stop_id").isNotNull()).select(
        "stop_id", "parent_stop_id"
    )
    known = stops.select(F.col("stop_id").alias("parent_stop_id")).distinct()
    return links.join(known, "parent_stop_id", "left_semi").select(
        F.col("stop_id").alias("src"), F.col("parent_stop_id").alias("dst")
    )


def _component_points(labelled: DataFrame) -> DataFrame:
    """(label, name, latitude, longitude): mean position of each component under each name."""
    usable = usable_position(F.col("latitude"), F.col("longitude"))
    positions = (
        labelled.filter(usable)
        .groupBy("label")
        .agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))
    )
    names = labelled.select("label", normalize_name(F.col("name")).alias("name")).distinct()
    return names.join(positions, "label")


def _tiled(points: DataFrame) -> DataFrame:
    """Grid cell of each point, and one of 3 x 3 tiles in it.

    A tile is less than 109 m across anywhere on earth, so points of one name in one tile are
    always close enough to be linked.
    """
    lat, lon = F.col("latitude") / CELL_LAT, F.col("longitude") / CELL_LON
    return (
        points.withColumn("cell_y", F.floor(lat))
        .withColumn("cell_x", F.floor(lon))
        .withColumn("tile_y", F.floor((lat - F.col("cell_y")) * TILES))
        .withColumn("tile_x", F.floor((lon - F.col("cell_x")) * TILES))
    )


TILE = ("name", "cell_y", "cell_x", "tile_y", "tile_x")


def _neighbour_tiles(tiles: DataFrame) -> DataFrame:
    """Pairs of occupied tiles of one name in the same or adjacent cells, each pair once.

    There are at most 81 tiles around any tile, so this does not grow with the points.
    """
    offsets = F.array(
        *(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (-1, 0, 1) for x in (-1, 0, 1))
    )
    left = (
        tiles.select(*(F.col(name).alias(f"a_{name}") for name in tiles.columns))
        .withColumn("o", F.explode(offsets))
        .withColumn("name", F.col("a_name"))
        .withColumn("cell_y", F.col("a_cell_y") + F.col("o.y"))
        .withColumn("cell_x", F.col("a_cell_x") + F.col("o.x"))
        .drop("o")
    )
    first = F.struct("a_cell_y", "a_cell_x", "a_tile_y", "a_tile_x")
    second = F.struct("cell_y", "cell_x", "tile_y", "tile_x")
    return left.join(tiles, ["name", "cell_y", "cell_x"]).filter(first < second)


def _gap(low_a: str, high_a: str, low_b: str, high_b: str) -> Column:
    return F.greatest(
        F.col(low_b) - F.col(high_a), F.col(low_a) - F.col(high_b), F.lit(0.0)
    )


def _span(low_a: str, high_a: str, low_b: str, high_b: str) -> Column:
    return F.greatest(F.col(high_a), F.col(high_b)) - F.least(F.col(low_a), F.col(low_b))


def _tile_verdicts(pairs: DataFrame) -> DataFrame:
    """`close` when all points of two tiles are within reach, `open` when some may be."""
    lats = ("a_south", "a_north", "south", "north")
    lons = ("a_west", "a_east", "west", "east")
    nearest_pole = F.least(
        F.abs(F.least("a_south", "south")), F.abs(F.greatest("a_north", "north"))
    )
    crosses_equator = F.least("a_south", "south") * F.greatest("a_north", "north") < 0
    widest = F.when(crosses_equator, 1.0).otherwise(F.cos(F.radians(nearest_pole)))
    most = EARTH_RADIUS_M * F.hypot(
        F.radians(_span(*lats)), widest * F.radians(_span(*lons))
    )
    # No two points are nearer than the gaps, measured where meridians are closest together.
    farthest_pole = F.greatest(F.abs(F.least("a_south", "south")), F.abs(F.greatest("a_north", "north")))
    across = F.cos(F.radians(farthest_pole)) * F.sin(F.radians(_gap(*lons)) / 2)
    least = 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.hypot(F.sin(F.radians(_gap(*lats)) / 2), across)))
    return pairs.withColumn(
        "verdict",
        F.when(most < MERGE_DISTANCE_M - 0.001, F.lit("close"))
        .when(least > MERGE_DISTANCE_M + 0.001, F.lit("far"))
        .otherwise(F.lit("open")),
    )


def _name_edges(points: DataFrame) -> DataFrame:
    """Edges between components that share a name and lie within the merge distance.

    Only the connected components of these edges matter, so a crowd of same-named components
    is linked through one of them per tile instead of pair by pair. Tile pairs that are close
    as a whole need one edge; single points are compared only where two tiles are neither
    surely close nor surely far and nothing else has joined them yet.
    """
    tiled = cut_lineage(_tiled(points))
    tiles = tiled.groupBy(*TILE).agg(
        F.min("label").alias("head"),
        F.min("latitude").alias("south"),
        F.max("latitude").alias("north"),
        F.min("longitude").alias("west"),
        F.max("longitude").alias("east"),
    )
    inside = (
        tiled.select(*TILE, "label")
        .join(tiles.select(*TILE, "head"), list(TILE))
        .select(F.col("head").alias("src"), F.col("label").alias("dst"))
        .filter("src != dst")
    )
    pairs = cut_lineage(
        _tile_verdicts(_neighbour_tiles(tiles)).filter("verdict != 'far'")
    )
    sure = inside.unionByName(
        pairs.filter("verdict = 'close'").select(
            F.col("a_head").alias("src"), F.col("head").alias("dst")
        )
    )
    sure = cut_lineage(sure)
    unsure = pairs.filter("verdict = 'open'")
    if unsure.isEmpty():
        return sure
    joined = connected_components(sure)
    a_root = joined.select(F.col("node").alias("a_head"), F.col("label").alias("a_root"))
    root = joined.select(F.col("node").alias("head"), F.col("label").alias("root"))
    apart = (
        unsure.join(a_root, "a_head", "left")
        .join(root, "head", "left")
        .filter(F.coalesce("a_root", "a_head") != F.coalesce("root", "head"))
        .select("name", *(f"{side}{part}" for side in ("a_", "") for part in TILE[1:]))
    )
    # Components at the very same spot behave alike: compare one of them.
    spots = keep_table(tiled.groupBy(*TILE, "latitude", "longitude").agg(F.min("label").alias("label")))
    return sure.unionByName(_edges_between(apart, spots))


#: Two boxes are compared spot by spot if their numbers of spots multiply to no more than this.
COMPARED_SPOTS = 4_096
#: Halvings after which boxes are compared whatever they hold: below a metre.
MOST_HALVINGS = 16

BOX = (*TILE, "sub_y", "sub_x")


def _boxes(spots: DataFrame, halvings: int) -> DataFrame:
    """Spots with the place of their box in the tile, halved so many times along both sides."""

    def part(axis: str, units: Column) -> Column:
        inside = (units - F.col(f"cell_{axis}")) * TILES - F.col(f"tile_{axis}")
        return F.floor(F.least(F.greatest(inside, F.lit(0.0)), F.lit(1 - 1e-12)) * 2**halvings)

    return spots.withColumn("sub_y", part("y", F.col("latitude") / CELL_LAT)).withColumn(
        "sub_x", part("x", F.col("longitude") / CELL_LON)
    )


def _sided(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """`df` for the left side of a pair: all but the name with a_ in front."""
    return df.select("name", *(F.col(name).alias(f"a_{name}") for name in columns if name != "name"))


def _edges_between(pairs: DataFrame, spots: DataFrame) -> DataFrame:
    """An edge for each pair of tiles that has two spots within the merge distance.

    As in a dual tree, pairs of boxes are halved together until they are close or far as a whole, or hold few
    spots. A tile is one component already, so the first edge ends the work on its pair.
    """
    left_tile = [f"a_{part}" for part in TILE[1:]]
    tops = ["name", *left_tile, *TILE[1:]]
    left_box, right_box = ["name", *(f"a_{part}" for part in BOX[1:])], list(BOX)
    zero = F.lit(0).cast("long")
    front = pairs.withColumns({name: zero for name in ("a_sub_y", "a_sub_x", "sub_y", "sub_x")})
    edges: DataFrame | None = None
    for halvings in range(MOST_HALVINGS + 1):
        placed = _boxes(spots, halvings)
        sizes = placed.groupBy(*BOX).agg(
            F.count(F.lit(1)).alias("n"),
            F.min("label").alias("head"),
            F.min("latitude").alias("south"),
            F.max("latitude").alias("north"),
            F.min("longitude").alias("west"),
            F.max("longitude").alias("east"),
        )
        parts = (*BOX, "n", "head", "south", "north", "west", "east")
        if halvings:
            # Each box has up to four occupied parts.
            parents = {name: F.shiftright(name, 1) for name in ("sub_y", "sub_x")}
            fine = ["fine_y", "fine_x"]
            inner = sizes.withColumns({"fine_y": F.col("sub_y"), "fine_x": F.col("sub_x")}).withColumns(parents)
            front = front.join(_sided(inner, (*parts, *fine)), left_box).join(inner, right_box)
            for side in ("a_", ""):
                front = front.drop(f"{side}sub_y", f"{side}sub_x").withColumnsRenamed(
                    {f"{side}fine_y": f"{side}sub_y", f"{side}fine_x": f"{side}sub_x"}
                )
        else:
            front = front.join(_sided(sizes, parts), left_box).join(sizes, right_box)
        front = keep_table(_tile_verdicts(front).filter("verdict != 'far'"))
        few = (F.col("a_n") * F.col("n") <= COMPARED_SPOTS) | F.lit(halvings == MOST_HALVINGS)
        compared = (
            front.filter((F.col("verdict") == "open") & few)
            .select(*tops, *(name for name in (*left_box, *right_box) if name not in tops))
            .join(_sided(placed, (*BOX, "latitude", "longitude", "label")), left_box)
            .join(placed, right_box)
            .filter(
                haversine_m(F.col("a_latitude"), F.col("a_longitude"), F.col("latitude"), F.col("longitude"))
                <= MERGE_DISTANCE_M
            )
            .select(*tops, F.col("a_label").alias("src"), F.col("label").alias("dst"))
        )
        close = front.filter("verdict = 'close'").select(
            *tops, F.col("a_head").alias("src"), F.col("head").alias("dst")
        )
        # One edge for a pair of tiles will do.
        found = keep_table(
            close.unionByName(compared)
            .groupBy(*tops)
            .agg(F.min(F.struct("src", "dst")).alias("edge"))
            .select(*tops, "edge.src", "edge.dst")
        )
        edges = found.select("src", "dst") if edges is None else edges.unionByName(found.select("src", "dst"))
        front = front.filter((F.col("verdict") == "open") & ~few).join(found.select(*tops), tops, "left_anti")
        front = front.select(*tops, "a_sub_y", "a_sub_x", "sub_y", "sub_x")
        if front.isEmpty():
            break
    return edges


def group_labels(stops: DataFrame) -> DataFrame:
    """Stops with `label`, the smallest stop id of their group's linked components."""
    by_parent = cut_lineage(_with_labels(stops, connected_components(_parent_edges(stops))))
    merged = connected_components(_name_edges(_component_points(by_parent)))
    return by_parent.join(
        merged.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left"
    ).withColumn("label", F.coalesce("root", "label")).drop("root")


def derive_stop_groups(stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """stops to (groups, members). Every stop is in exactly one group, alone if need be.

    A group is named after its first station, or its first stop if it has none. Its position, the mean of its
    stations or else stops, is rounded to `POSITION_DIGITS`.
    """
    labelled = cut_lineage(
        group_labels(
            stops.select(
                "stop_id",
                "name",
                "latitude",
                "longitude",
                F.coalesce("location_type", F.lit(0)).alias("location_type"),
                "parent_stop_id",
            )
        )
    )
    usable = usable_position(F.col("latitude"), F.col("longitude"))
    station = F.col("location_type") == STATION

    def mean(column: str) -> Column:
        of_stations = F.avg(F.when(usable & station, F.col(column)))
        return F.round(F.coalesce(of_stations, F.avg(F.when(usable, F.col(column)))), POSITION_DIGITS)

    summary = labelled.groupBy("label").agg(
        F.coalesce(F.min(F.when(station, F.col("stop_id"))), F.min("stop_id")).alias("preferred"),
        mean("latitude").alias("latitude"),
        mean("longitude").alias("longitude"),
        F.min(F.when(usable, F.col("latitude"))).alias("min_latitude"),
        F.min(F.when(usable, F.col("longitude"))).alias("min_longitude"),
        F.max(F.when(usable, F.col("latitude"))).alias("max_latitude"),
        F.max(F.when(usable, F.col("longitude"))).alias("max_longitude"),
        F.count(F.lit(1)).alias("member_count"),
    )
    names = labelled.select(F.col("stop_id").alias("preferred"), "name")
    group_id = F.concat(F.lit("group:"), F.col("preferred"))
    groups = summary.join(names, "preferred").withColumn("group_id", group_id)
    members = labelled.join(groups.select("label", "group_id"), "label").select(
        "group_id", "stop_id"
    )
    return groups.select(*GROUP_COLUMNS), members


def _pairs_of(timetable: Timetable, members: DataFrame, whole: bool) -> DataFrame:
    """(group_id, stop_id, route_id) of the members. With `whole` calls are not shuffled to look for their stops first."""
    return members.join(stop_route_pairs(timetable, None if whole else members), "stop_id")


def group_member_routes(timetable: Timetable, members: DataFrame, whole: bool = False) -> DataFrame:
    """(group_id, stop_id, route_id, agency_id), each once.

    `whole` says that the members are most stops of the timetable, here and below; the result is the same without.
    """
    return (
        _pairs_of(timetable, members, whole)
        .join(timetable.routes.select("route_id", "agency_id"), "route_id")
        .select("group_id", "stop_id", "route_id", "agency_id")
    )


def group_routes(timetable: Timetable, members: DataFrame, whole: bool = False) -> DataFrame:
    """Routes that call anywhere in a group."""
    return _routes_of(timetable, _pairs_of(timetable, members, whole))


def _routes_of(timetable: Timetable, pairs: DataFrame) -> DataFrame:
    distinct = pairs.select("group_id", "route_id").distinct()
    return distinct.join(timetable.routes, "route_id").select("group_id", *ROUTE_COLUMNS)


def group_agencies(timetable: Timetable, members: DataFrame, whole: bool = False) -> DataFrame:
    """Agencies of those routes. A route without an agency adds none."""
    return _agencies_of(timetable, group_routes(timetable, members, whole))


def _agencies_of(timetable: Timetable, routes: DataFrame) -> DataFrame:
    pairs = routes.select("group_id", "agency_id").dropna().distinct()
    return pairs.join(timetable.agencies, "agency_id").select("group_id", *AGENCY_COLUMNS)


def _in_parts(rows: DataFrame, keys: list[str], item: str, key: str, size: int) -> DataFrame:
    """Items per group spread over ceil(n / size) parts, so that no array grows with a group."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / size)
    return (
        rows.join(counts, keys)
        .withColumn("part", F.pmod(F.xxhash64(key), parts).cast("int"))
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list(item)).alias(item))
    )


def stop_group_details(
    timetable: Timetable,
    groups: DataFrame,
    members: DataFrame,
    requests: DataFrame,
    part_size: int = MEMBERS_PER_PART,
) -> DataFrame:
    """requests(request_id, group_id) to the group with its members, routes and agencies.

    A group of up to `part_size` members is one row. Larger groups come in several rows,
    numbered by `part`, which together hold every member, route and agency once.
    """
    asked = requests.select("group_id").distinct()
    wanted = keep_table(members.join(asked, "group_id", "left_semi"))
    whole = MOST_STOPS * wanted.count() >= timetable.stops.count()
    stops = timetable.stops.withColumn("location_type", F.coalesce("location_type", F.lit(0)))
    # Members, routes and agencies all come from the pairs of the wanted stops, found once.
    pairs = keep_table(group_member_routes(timetable, wanted, whole))
    served = (
        pairs.groupBy("stop_id")
        .agg(
            F.array_sort(F.collect_set("route_id")).alias("route_ids"),
            F.array_sort(F.collect_set("agency_id")).alias("agency_ids"),
        )
    )
    empty = F.array().cast("array<string>")
    member_items = (
        wanted.join(stops, "stop_id")
        .join(served, "stop_id", "left")
        .select(
            "group_id",
            "stop_id",
            F.struct(
                *STOP_COLUMNS,
                F.coalesce("route_ids", empty).alias("route_ids"),
                F.coalesce("agency_ids", empty).alias("agency_ids"),
            ).alias("members"),
        )
    )
    route_items = _routes_of(timetable, pairs).select(
        "group_id", "route_id", F.struct(*ROUTE_COLUMNS).alias("routes")
    )
    agency_items = _agencies_of(timetable, pairs).select(
        "group_id", "agency_id", F.struct(*AGENCY_COLUMNS).alias("agencies")
    )
    keys = ["group_id", "part"]
    detail = (
        _in_parts(member_items, ["group_id"], "members", "stop_id", part_size)
        .join(_in_parts(route_items, ["group_id"], "routes", "route_id", part_size), keys, "full")
        .join(
            _in_parts(agency_items, ["group_id"], "agencies", "agency_id", part_size),
            keys,
            "full",
        )
    )

    def or_empty(name: str) -> Column:
        return F.coalesce(name, F.array().cast(detail.schema[name].dataType)).alias(name)

    return (
        requests.select("request_id", "group_id")
        .join(groups, "group_id")
        .join(detail, "group_id")
        .select(
            "request_id",
            *GROUP_COLUMNS,
            "part",
            or_empty("members"),
            or_empty("routes"),
            or_empty("agencies"),
        )
    )
