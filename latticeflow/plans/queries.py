"""Every operator as a query on the driver's tables, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import affine, scalars
from ..functions.geometry import AXES, Box, Vec, explode_chunks, hull_of, morton, parse_mag
from ..operators import aggregate, catalog, graph, region, resample
from ..sources import arrays, nml, volumes
from ..streaming import slices
from .lattice import edges, nodes, points, seg, sql, table, vox
from .tables import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLE[fn.__name__] = oracle
        return fn

    return add


def longs(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


READ = Box(Vec(10, 5, 1), Vec(200, 60, 4))
DENSE = Box(Vec(1, 1, 0), Vec(41, 41, 8))


# --- regions -----------------------------------------------------------------


@query(sql("vox", then="SELECT * FROM vox WHERE x >= 10 AND x < 200 AND y >= 5 AND y < 60 AND z >= 1 AND z < 4"))
def read_bbox_sparse(spark, d):
    return region.read(vox(spark, d), READ)


@query(
    sql(
        "vox",
        then="SELECT g.x, g.y, g.z, coalesce(v, 0) AS v FROM (SELECT a.i AS x, b.i AS y, c.i AS z FROM range(1, 41) a(i), range(1, 41) b(i), range(0, 8) c(i)) g "
        "LEFT JOIN vox ON g.x = vox.x AND g.y = vox.y AND g.z = vox.z",
    )
)
def read_bbox_dense(spark, d):
    return region.read_dense(vox(spark, d), DENSE)


@query(
    sql(
        "vox",
        "vox_r",
        then=", inside AS (SELECT * FROM vox_r WHERE x >= 10 AND x < 200 AND y >= 5 AND y < 60 AND z >= 1 AND z < 4) "
        "SELECT * FROM vox WHERE NOT (x >= 10 AND x < 200 AND y >= 5 AND y < 60 AND z >= 1 AND z < 4) UNION ALL SELECT x, y, z, v FROM inside WHERE v <> 0",
    ).replace(") , inside", "), inside")
)
def write_region(spark, d):
    return region.write(vox(spark, d), vox(spark, d, "R"), READ)


@query(
    sql(
        "vox",
        "vox_r",
        then="SELECT * FROM vox WHERE NOT EXISTS (SELECT 1 FROM vox_r r WHERE r.x // 32 = vox.x // 32 AND r.y // 32 = vox.y // 32 AND r.z // 4 = vox.z // 4) "
        "UNION ALL SELECT * FROM vox_r WHERE v <> 0",
    )
)
def merge_overlay(spark, d):
    return region.overlay(vox(spark, d), vox(spark, d, "R"), (32, 32, 4))


@query(
    sql(
        "vox",
        "vox_r",
        then="SELECT a.n::BIGINT AS only_left, b.n::BIGINT AS only_right, a.n = 0 AND b.n = 0 AS equal FROM (SELECT count(*) AS n FROM (SELECT * FROM vox EXCEPT SELECT * FROM vox_r)) a, "
        "(SELECT count(*) AS n FROM (SELECT * FROM vox_r EXCEPT SELECT * FROM vox)) b",
    )
)
def content_equal(spark, d):
    return region.content_difference(vox(spark, d), vox(spark, d, "R")).select(*longs("only_left", "only_right"), "equal")


@query(
    sql(
        "vox",
        then="SELECT x // 64 AS cx, y // 64 AS cy, z // 4 AS cz, x // 64 * 64 AS x0, y // 64 * 64 AS y0, z // 4 * 4 AS z0, x // 64 * 64 + 64 AS x1, "
        "y // 64 * 64 + 64 AS y1, z // 4 * 4 + 4 AS z1, count(*) AS n, sum(v)::BIGINT AS total FROM vox WHERE v <> 0 GROUP BY ALL",
    )
)
def chunk_occupancy(spark, d):
    return region.chunk_occupancy(vox(spark, d), (64, 64, 4))


@query(sql("vox", then="SELECT * FROM vox WHERE v <> 0"))
def rechunk_roundtrip(spark, d):
    """Voxels to dense chunks, re-tiled to another shape, and back."""
    first = region.to_chunks(vox(spark, d), (64, 64, 8))
    return region.from_chunks(region.to_chunks(region.from_chunks(first), (32, 128, 4)))


@query(sql("vox", then="SELECT x // 64 AS cx, y // 64 AS cy, z // 8 AS cz, count(*) AS filled, max(v) AS top FROM vox WHERE v <> 0 GROUP BY ALL"))
def map_chunk(spark, d):
    chunks = region.to_chunks(vox(spark, d), (64, 64, 8))
    return region.map_chunks(chunks, lambda box, a: {"filled": int((a != 0).sum()), "top": int(a.max())}, "filled long, top long")


@query(
    sql(
        "vox",
        "vox_r",
        then="SELECT x, y, z, (coalesce(vox.v, 0) + 2 * coalesce(r.v, 0))::BIGINT AS v FROM vox FULL JOIN vox_r r USING (x, y, z)",
    )
)
def for_zipped_chunks(spark, d):
    def add(a, b):
        return (0 if a is None else a) + 2 * (0 if b is None else b)

    pair = [region.to_chunks(vox(spark, d, f), (64, 64, 8)) for f in (None, "R")]
    return region.from_chunks(region.zip_chunks(*pair, add))


@query(sql("vox", then="SELECT x, y, z - 1 AS z, v FROM vox"))
def slice_shift(spark, d):
    return region.shifted(vox(spark, d), (0, 0, -1))


@query(sql("vox", then="SELECT x, 4095 - y AS y, z, v FROM vox"))
def flip_axis(spark, d):
    return region.flipped(vox(spark, d), "y", 4096)


@query(
    sql(
        "vox",
        then="SELECT x - 200 AS x, y + 28 AS y, z + 4 AS z, v FROM vox WHERE x - 200 >= 0 AND x - 200 < 600 AND y + 28 < 120 AND z + 4 < 16",
    )
)
def pad_crop(spark, d):
    return region.pad_or_crop(vox(spark, d), (1000, 64, 8), (600, 120, 16))


@query(
    sql(
        "seg",
        then="SELECT x, y, z, coalesce(n_nationkey, 0)::BIGINT AS v FROM seg LEFT JOIN (SELECT s_suppkey, s_nationkey AS n_nationkey FROM supplier WHERE s_acctbal > 0) ON v = s_suppkey",
    )
)
def apply_mapping(spark, d):
    mapping = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("mapped"))
    return region.apply_mapping(seg(spark, d), mapping)


@query(sql("vox", "vox_r", then="SELECT * FROM vox WHERE EXISTS (SELECT 1 FROM vox_r r WHERE r.x = vox.x AND r.y = vox.y AND r.z = vox.z AND r.v > 0)"))
def mask_filter(spark, d):
    return region.masked(vox(spark, d), vox(spark, d, "R"))


@query(sql("vox", then="SELECT x, y, z, trunc((v - 5) / (45.0 - 5.0)::DOUBLE * 255.0::DOUBLE)::BIGINT AS v FROM vox"))
def rescale_min_max(spark, d):
    return region.rescaled(vox(spark, d), 5.0, 45.0, 255.0)


def _hull(v: DataFrame) -> Box:
    b = aggregate.bounding_box(v).first()
    return Box(Vec(b.x0, b.y0, b.z0), Vec(b.x1, b.y1, b.z1)) if b and b.x0 is not None else Box.of(0, (0, 0, 0))


# The whole lattice is moved; results are sparse, what they leave out is the fill.


@query(sql("vox", then="SELECT x + 7 AS x, y + 3 AS y, z + 1 AS z, v FROM vox WHERE v <> 0"))
def affine_translate(spark, d):
    v = vox(spark, d)
    return region.moved(v, affine.translation((7, 3, 1)), _hull(v))


@query(
    sql(
        "vox",
        then="SELECT 2 * x + a AS x, 2 * y + b AS y, z, v FROM vox, (VALUES (-1), (0)) p(a), (VALUES (-1), (0)) q(b) "
        "WHERE v <> 0 AND x + a / 2.0 >= (SELECT min(x) FROM vox WHERE v <> 0) AND y + b / 2.0 >= (SELECT min(y) FROM vox WHERE v <> 0)",
    )
)
def affine_scale_nn(spark, d):
    v = vox(spark, d)
    return region.moved(v, affine.scale((2, 2, 1)), _hull(v))


@query(sql("vox", then="SELECT (SELECT max(y) + 1 FROM vox WHERE v <> 0) - y AS x, x AS y, z, v FROM vox WHERE v <> 0"))
def affine_rotate90(spark, d):
    v = vox(spark, d)
    hull = _hull(v)
    turn = affine.chain(affine.rotation("z", 90), affine.translation((hull.high.y, 0, 0)))
    return region.moved(v, turn, hull)


@query(sql("vox", "vox_r", then="SELECT x - 1 AS x, y, z, vox.v FROM vox JOIN vox_r USING (x, y, z) WHERE vox.v <> 0 AND vox_r.v > 0"))
def affine_masked_fill(spark, d):
    v = vox(spark, d)
    return region.moved(v, affine.translation((-1, 0, 0)), _hull(v), mask=vox(spark, d, "R"))


@query(sql("vox", then="SELECT z // 3 AS batch, count(DISTINCT z) AS slices, max(x) + 1 AS width, max(y) + 1 AS height, count(*) AS n FROM vox GROUP BY 1"))
def slice_batches(spark, d):
    return region.slice_batches(vox(spark, d), "z", 3).select(*longs("batch", "slices", "width", "height", "n"))


@query(sql("vox", then="SELECT z, x // 256 AS tx, y // 256 AS ty, count(*) AS n, max(v) AS top FROM vox GROUP BY ALL"))
def tile_keys(spark, d):
    return region.tiles(vox(spark, d), 256)


# --- boxes, vectors, chunks --------------------------------------------------


def boxes(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), F.col("l_linenumber").cast("long").alias("z")
    )
    return hull_of(lines, ["id"], Vec.columns())


def _boxed(df: DataFrame, box: Box, *more) -> DataFrame:
    return df.select("id", *box.named(), *more)


@query(sql("boxes", then="SELECT * FROM boxes"))
def bbox_from_points(spark, d):
    return boxes(spark, d)


@query(sql("boxes", then="SELECT min(x0) AS x0, min(y0) AS y0, min(z0) AS z0, max(x1) AS x1, max(y1) AS y1, max(z1) AS z1 FROM boxes"))
def bbox_hull(spark, d):
    b = boxes(spark, d)
    return b.agg(*[F.min(c).alias(c) for c in ("x0", "y0", "z0")], *[F.max(c).alias(c) for c in ("x1", "y1", "z1")])


@query(sql("boxes", then="SELECT id, x0 // 4 * 4 AS x0, y0 // 4 * 4 AS y0, z0 // 2 * 2 AS z0, (x1 + 3) // 4 * 4 AS x1, (y1 + 3) // 4 * 4 AS y1, (z1 + 1) // 2 * 2 AS z1 FROM boxes"))
def bbox_align_ceil(spark, d):
    return _boxed(boxes(spark, d), Box.columns().aligned((4, 4, 2), ceil=True))


@query(sql("boxes", then="SELECT id, (x0 + 3) // 4 * 4 AS x0, (y0 + 3) // 4 * 4 AS y0, (z0 + 1) // 2 * 2 AS z0, x1 // 4 * 4 AS x1, y1 // 4 * 4 AS y1, z1 // 2 * 2 AS z1 FROM boxes"))
def bbox_align_floor(spark, d):
    return _boxed(boxes(spark, d), Box.columns().aligned((4, 4, 2), ceil=False))


@query(sql("boxes", then="SELECT id, x0 // 4 AS x0, y0 // 4 AS y0, z0 // 2 AS z0, (x1 + 3) // 4 AS x1, (y1 + 3) // 4 AS y1, (z1 + 1) // 2 AS z1 FROM boxes"))
def bbox_in_mag(spark, d):
    return _boxed(boxes(spark, d), Box.columns().aligned((4, 4, 2), ceil=True).in_mag((4, 4, 2)))


@query(sql("boxes", then="SELECT id, x0 * 4 AS x0, y0 * 4 AS y0, z0 * 2 AS z0, x1 * 4 AS x1, y1 * 4 AS y1, z1 * 2 AS z1 FROM boxes"))
def bbox_from_mag1(spark, d):
    return _boxed(boxes(spark, d), Box.columns().from_mag((4, 4, 2)))


@query(
    sql(
        "boxes",
        then="SELECT id, greatest(x0, 100) AS x0, greatest(y0, 20) AS y0, greatest(z0, 2) AS z0, greatest(least(x1, 900), greatest(x0, 100)) AS x1, "
        "greatest(least(y1, 70), greatest(y0, 20)) AS y1, greatest(least(z1, 6), greatest(z0, 2)) AS z1 FROM boxes",
    )
)
def bbox_intersect(spark, d):
    return _boxed(boxes(spark, d), Box.columns().intersected(Box(Vec(100, 20, 2), Vec(900, 70, 6))))


@query(sql("boxes", then="SELECT id, x0 - 3 AS x0, y0 - 2 AS y0, z0 - 1 AS z0, x1 + 1 AS x1, y1 + 1 AS y1, z1 + 1 AS z1 FROM boxes"))
def bbox_pad(spark, d):
    return _boxed(boxes(spark, d), Box.columns().padded((3, 2, 1), 1))


@query(sql("boxes", then="SELECT id, (x1 - x0) * (y1 - y0) * (z1 - z0) AS volume, greatest(x1 - x0, y1 - y0, z1 - z0) AS longest FROM boxes"))
def bbox_volume(spark, d):
    b = Box.columns()
    return boxes(spark, d).select("id", b.volume().alias("volume"), b.size.largest().alias("longest"))


@query(
    sql(
        "boxes",
        then="SELECT id, x0 <= 500 AND 500 < x1 AND y0 <= 17 AND 17 < y1 AND z0 <= 3 AND 3 < z1 AS holds_point, x0 >= 1 AND x1 <= 1990 AND y0 >= 1 AND y1 <= 50 AND z0 >= 0 AND z1 <= 8 AS in_box FROM boxes",
    )
)
def bbox_contains(spark, d):
    b = Box.columns()
    point = Vec(*[F.lit(v).cast("long") for v in (500, 17, 3)])
    return boxes(spark, d).select("id", b.contains(point).alias("holds_point"), Box(Vec(1, 1, 0), Vec(1990, 50, 8)).contains_box(b).alias("in_box"))


@query(sql("boxes", then="SELECT id, least(x0, x0 - y0 * 3) AS x0, y0, z0, greatest(x0, x0 - y0 * 3) AS x1, y1, z1 FROM boxes"))
def bbox_negative_size(spark, d):
    b = Box.columns()
    return _boxed(boxes(spark, d), Box.of(b.low, Vec(-b.low.y * 3, b.size.y, b.size.z)))


@query(
    sql(
        "boxes",
        then="SELECT x0 // 16 * 16 AS x0, y0 // 16 * 16 AS y0, z0 // 8 * 8 AS z0, (x1 + 15) // 16 * 16 AS x1, (y1 + 15) // 16 * 16 AS y1, (z1 + 7) // 8 * 8 AS z1, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM boxes GROUP BY ALL",
    )
)
def bbox_group_aligned(spark, d):
    grown = _boxed(boxes(spark, d), Box.columns().aligned((16, 16, 8), ceil=True))
    return grown.groupBy("x0", "y0", "z0", "x1", "y1", "z1").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(
    sql(
        "boxes",
        then=", m AS (SELECT id, unnest([[x0, y0, z0], [x0, y0, z1], [x0, y1, z0], [x0, y1, z1], [x1, y0, z0], [x1, y0, z1], [x1, y1, z0], [x1, y1, z1]]) AS p FROM boxes) "
        "SELECT id, floor(min(p[1] * 0.5 + 3))::BIGINT AS x0, floor(min(p[2] * 1.0 + p[3] * 0.25))::BIGINT AS y0, floor(min(p[3] * 2.0 - 1))::BIGINT AS z0, "
        "ceil(max(p[1] * 0.5 + 3))::BIGINT AS x1, ceil(max(p[2] * 1.0 + p[3] * 0.25))::BIGINT AS y1, ceil(max(p[3] * 2.0 - 1))::BIGINT AS z1 FROM m GROUP BY id",
    ).replace(") , m AS", "), m AS")
)
def bbox_transform(spark, d):
    shear = [[0.5, 0, 0, 3.0], [0, 1.0, 0.25, 0], [0, 0, 2.0, -1.0], [0, 0, 0, 1.0]]
    return _boxed(boxes(spark, d), affine.apply_to_box(shear, Box.columns()))


@query(
    sql(
        "boxes",
        then="SELECT id, a.x AS x0, y0, a.z AS z0, least(a.x + 64, x1) AS x1, y1, least(a.z + 4, z1) AS z1 FROM (SELECT *, unnest(range(x0, x1, 64)) AS x FROM boxes) b, LATERAL (SELECT b.x AS x, unnest(range(b.z0, b.z1, 4)) AS z) a",
    )
)
def chunk_grid(spark, d):
    return explode_chunks(boxes(spark, d), Box.columns(), (64, 64, 4))


@query(
    sql(
        "boxes",
        then="SELECT id, greatest(a.x, x0) AS x0, y0, greatest(a.z, z0) AS z0, least(a.x + 64, x1) AS x1, y1, least(a.z + 4, z1) AS z1 FROM (SELECT *, unnest(range(x0 // 32 * 32, x1, 64)) AS x FROM boxes) b, LATERAL (SELECT b.x AS x, unnest(range(b.z0 // 4 * 4, b.z1, 4)) AS z) a",
    )
)
def chunk_grid_aligned(spark, d):
    return explode_chunks(boxes(spark, d), Box.columns(), (64, 64, 4), (32, 1, 4))


@query(
    sql(
        "vox",
        then="SELECT DISTINCT x // 32 AS cx, y // 32 AS cy, z // 4 AS cz, list_sum(list_transform(range(15), lambda b: ((((x // 32) >> b) & 1) << (3 * b)) + ((((y // 32) >> b) & 1) << (3 * b + 1)) + ((((z // 4) >> b) & 1) << (3 * b + 2))))::BIGINT AS morton FROM vox",
    )
)
def morton_index(spark, d):
    return vox(spark, d).select(*region.chunk_key((32, 32, 4))).distinct().withColumn("morton", morton(Vec.columns("c")))


@query(
    sql(
        "nodes",
        then="SELECT tree, node, (x + 6) // 7 AS cx, -((-y) // 5 - CASE WHEN (-y) % 5 <> 0 THEN 1 ELSE 0 END) AS up, greatest(x, y) AS hi, least(y, z) AS lo, x * y * z AS vol, x = y AND y = z AS uniform, ((x - 1000) % 7 + 7) % 7 AS wrapped FROM nodes",
    ).replace("-((-y) // 5 - CASE WHEN (-y) % 5 <> 0 THEN 1 ELSE 0 END)", "(y + 4) // 5")
)
def vector_arithmetic(spark, d):
    p = Vec.columns()
    return nodes(spark, d).select(
        "tree", "node", p.ceil_div(7).x.alias("cx"), p.ceil_div(5).y.alias("up"), p.pair_max(p.moved(0, 1)).x.alias("hi"), F.least("y", "z").alias("lo"),
        p.product().alias("vol"), p.is_uniform().alias("uniform"), ((p - 1000) % 7).x.alias("wrapped"),
    )


@query(
    "SELECT p_partkey, x, y, z, bit_count(x) = 1 AND bit_count(y) = 1 AND bit_count(z) = 1 AS valid FROM (SELECT p_partkey, (1::BIGINT << (p_size % 5)) AS x, CASE WHEN p_size % 3 = 0 THEN (1::BIGINT << (p_size % 5)) ELSE p_size % 7 + 1 END::BIGINT AS y, (1::BIGINT << (p_size % 5)) AS z FROM part)"
)
def mag_parse(spark, d):
    size = F.col("p_size")
    text = F.when(size % 3 == 0, F.expr("cast(shiftleft(1, p_size % 5) as string)")).otherwise(
        F.concat_ws("-", F.expr("shiftleft(1, p_size % 5)"), size % 7 + 1, F.expr("shiftleft(1, p_size % 5)"))
    )
    m = parse_mag(F.col("text"))
    return table(spark, d, "part").select("p_partkey", text.alias("text")).select(
        "p_partkey", m.x.alias("x"), m.y.alias("y"), m.z.alias("z"), m.is_power_of_two().alias("valid")
    )


# --- resampling --------------------------------------------------------------

_CELL = "x // 2 AS x, y // 2 AS y, z // 2 AS z"


@query(sql("vox", then=f"SELECT {_CELL}, max(v) AS v FROM vox GROUP BY ALL"))
def downsample_max(spark, d):
    return resample.downsample(vox(spark, d), 2, "max")


@query(sql("seg", then="SELECT x // 2 AS x, y // 2 AS y, 0::BIGINT AS z, min(v) AS v FROM seg WHERE v <> 0 GROUP BY ALL HAVING count(*) = 4"))
def downsample_min_dense(spark, d):
    return resample.downsample(seg(spark, d), (2, 2, 1), "min")


@query(
    sql(
        "seg",
        then="SELECT x // 2 AS x, y // 2 AS y, 0::BIGINT AS z, trunc((l[2] + l[3]) / 2)::BIGINT AS v FROM (SELECT x // 2 * 2 AS x, y // 2 * 2 AS y, list_sort(list_concat(list_transform(range(4 - count(*)), lambda i: 0::BIGINT), list(v))) AS l FROM seg WHERE v <> 0 GROUP BY ALL) WHERE trunc((l[2] + l[3]) / 2) <> 0",
    )
)
def downsample_median(spark, d):
    return resample.downsample(seg(spark, d), (2, 2, 1), "median")


@query(
    sql(
        "seg",
        then=", c AS (SELECT x // 2 AS cx, y // 2 AS cy, v, y % 2 + 2 * (x % 2) AS o FROM seg WHERE v <> 0), "
        "k AS (SELECT cx, cy, v, count(*) AS n, min(o) AS o FROM c GROUP BY ALL UNION ALL "
        "SELECT cx, cy, 0, 4 - count(*), list_min(list_filter([0, 1, 2, 3], lambda i: NOT list_contains(list(o), i))) FROM c GROUP BY cx, cy HAVING count(*) < 4) "
        "SELECT cx AS x, cy AS y, 0::BIGINT AS z, v::BIGINT AS v FROM (SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY n DESC, o) AS r FROM k) WHERE r = 1 AND v <> 0",
    ).replace(") , c AS", "), c AS")
)
def downsample_mode(spark, d):
    return resample.downsample(seg(spark, d), (2, 2, 1), "mode")


@query(
    sql(
        "vox",
        then=", a AS (SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, max(v) AS v FROM vox GROUP BY ALL), b AS (SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, max(v) AS v FROM a GROUP BY ALL), "
        "c AS (SELECT x // 4 AS x, y // 4 AS y, z // 1 AS z, max(v) AS v FROM b GROUP BY ALL) "
        "SELECT '2-2-2' AS mag, * FROM a UNION ALL SELECT '4-4-4', * FROM b UNION ALL SELECT '16-16-4', * FROM c",
    ).replace(") , a AS", "), a AS")
)
def downsample_pyramid(spark, d):
    return resample.pyramid(vox(spark, d), [2, 4, (16, 16, 4)], "max")


@query(sql("vox", then="SELECT x * 2 + a AS x, y * 2 + b AS y, z * 2 + c AS z, v FROM vox, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS c)"))
def upsample_2x(spark, d):
    return resample.upsample(vox(spark, d), 2)


# Tiles of 64 voxels become 32, first and last samples in place: sample k lies at 63 k / 31.
_NEAREST = "taps AS (SELECT k, r, 1.0::DOUBLE AS w FROM range(32) a(k), range(64) b(r) WHERE r = floor(k * 63.0::DOUBLE / 31 + 0.5))"
_LINEAR = "taps AS (SELECT k, r, 1 - abs(k * 63.0::DOUBLE / 31 - r) AS w FROM range(32) a(k), range(64) b(r) WHERE abs(k * 63.0::DOUBLE / 31 - r) < 1)"
_TILES = (
    ", sums AS (SELECT x // 64 * 32 + kx.k AS x, y // 64 * 32 + ky.k AS y, z // 64 * 32 + kz.k AS z, sum(v * kx.w * ky.w * kz.w) AS s FROM vox "
    "JOIN taps kx ON kx.r = x % 64 JOIN taps ky ON ky.r = y % 64 JOIN taps kz ON kz.r = z % 64 WHERE v <> 0 GROUP BY 1, 2, 3) "
    "SELECT x, y, z, floor(s + 0.5)::BIGINT AS v FROM sums WHERE floor(s + 0.5) <> 0"
)


@query(sql("vox", then=f", {_LINEAR}{_TILES}").replace(") , taps", "), taps"))
def downsample_bilinear(spark, d):
    return resample.resample_tiles(vox(spark, d), 2, "bilinear")


@query()
def downsample_bicubic(spark, d):
    return resample.resample_tiles(vox(spark, d), 2, "bicubic")


# --- aggregates --------------------------------------------------------------


@query(sql("seg", then="SELECT max(v)::BIGINT AS largest FROM seg"))
def largest_segment_id(spark, d):
    return aggregate.largest_id(seg(spark, d))


@query(sql("seg", then="SELECT v AS segment, count(*) AS n, round(count(*) * (11.24::DOUBLE * 11.24::DOUBLE * 25::DOUBLE * 4), 4) AS volume FROM seg WHERE v <> 0 GROUP BY 1"))
def segment_sizes(spark, d):
    return aggregate.segment_sizes(seg(spark, d), (11.24, 11.24, 25.0), (2, 2, 1)).withColumn("volume", F.round("volume", 4))


@query(sql("seg", then="SELECT v AS segment, min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x) + 1 AS x1, max(y) + 1 AS y1, max(z) + 1 AS z1 FROM seg WHERE v <> 0 GROUP BY 1"))
def segment_bbox(spark, d):
    return aggregate.segment_boxes(seg(spark, d))


@query(sql("vox", then="SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x) + 1 AS x1, max(y) + 1 AS y1, max(z) + 1 AS z1 FROM vox WHERE v <> 0"))
def dataset_bbox(spark, d):
    return aggregate.bounding_box(vox(spark, d))


@query(sql("vox", then="SELECT count(DISTINCT v) AS kinds, count(*) AS n, round(count(DISTINCT v) / count(*)::DOUBLE, 9) AS ratio, CASE WHEN count(DISTINCT v) / count(*)::DOUBLE > 1.0 / 200 THEN 'color' ELSE 'segmentation' END AS category FROM vox WHERE v <> 0 AND v < 50"))
def distinct_ratio(spark, d):
    return aggregate.distinct_ratio(vox(spark, d), 50)


@query()
def sampled_category(spark, d):
    voxels = vox(spark, d)
    b = aggregate.bounding_box(voxels).first()
    box = Box(Vec(b.x0, b.y0, b.z0), Vec(b.x1, b.y1, b.z1)) if b and b.x0 is not None else Box.of(0, (0, 0, 0))
    return aggregate.sampled_ratio(voxels, box, samples=200, side=16)


@query("SELECT l_returnflag AS actual, l_linestatus AS predicted, count(*) AS n FROM lineitem GROUP BY ALL")
def heuristic_confusion(spark, d):
    return aggregate.confusion(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


# --- skeletons and graphs ----------------------------------------------------


@query(
    sql(
        "nodes",
        "edges",
        then="SELECT tree, round(sum(sqrt(pow((a.x - b.x) * 11.24::DOUBLE, 2) + pow((a.y - b.y) * 11.24::DOUBLE, 2) + pow((a.z - b.z) * 25.0::DOUBLE, 2))), 4) AS length FROM edges e JOIN nodes a USING (tree) JOIN nodes b USING (tree) WHERE a.node = e.source AND b.node = e.target GROUP BY tree",
    )
)
def path_length(spark, d):
    n = nodes(spark, d)
    return graph.path_lengths(n, edges(n), (11.24, 11.24, 25.0)).withColumn("length", F.round("length", 4))


@query(sql("nodes", then="SELECT tree, count(*) AS n_nodes, max(node) AS max_node FROM nodes GROUP BY 1"))
def tree_stats(spark, d):
    return graph.tree_stats(nodes(spark, d))


@query(sql("nodes", "edges", then="SELECT tree, node, count(*) AS degree FROM (SELECT tree, source AS node FROM edges UNION ALL SELECT tree, target FROM edges) GROUP BY ALL"))
def tree_degree(spark, d):
    return graph.degrees(edges(nodes(spark, d)))


_PAIRS = (
    "nodes",
    "SELECT a.tree AS tree_a, a.node AS node_a, b.tree AS tree_b, b.node AS node_b, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz FROM nodes a JOIN nodes b ON a.y = b.y AND a.z = b.z AND b.x BETWEEN a.x - 2 AND a.x + 2 AND a.tree < b.tree "
    "UNION ALL SELECT a.tree, a.node, b.tree, b.node, a.x, a.y, a.z, b.x, b.y, b.z FROM nodes a JOIN nodes b ON a.x = b.x AND (a.y <> b.y OR a.z <> b.z) AND a.tree < b.tree AND (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 4 "
    "UNION ALL SELECT a.tree, a.node, b.tree, b.node, a.x, a.y, a.z, b.x, b.y, b.z FROM nodes a JOIN nodes b ON b.x = a.x + 1 AND (a.y <> b.y OR a.z <> b.z) AND a.tree <> b.tree AND a.tree < b.tree AND (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 3 "
    "UNION ALL SELECT a.tree, a.node, b.tree, b.node, a.x, a.y, a.z, b.x, b.y, b.z FROM nodes a JOIN nodes b ON b.x = a.x - 1 AND (a.y <> b.y OR a.z <> b.z) AND a.tree < b.tree AND (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 3",
)


def _pairs(then: str) -> str:
    return sql("nodes", then=f", p AS ({_PAIRS[1]}) {then}").replace(") , p AS", "), p AS")


@query(_pairs("SELECT tree_a, node_a, tree_b, node_b, round(sqrt((ax - bx) ** 2 + (ay - by_) ** 2 + (az - bz) ** 2), 4) AS distance FROM p"))
def synapse_pairs(spark, d):
    return graph.pairs_within(nodes(spark, d), 2.0).select("tree_a", "node_a", "tree_b", "node_b", F.round("distance", 4).alias("distance"))


@query(_pairs("SELECT tree_a, node_a, tree_b, node_b, round_even((ax + bx) / 2, 0)::BIGINT AS x, round_even((ay + by_) / 2, 0)::BIGINT AS y, round_even((az + bz) / 2, 0)::BIGINT AS z FROM p"))
def synapse_midpoints(spark, d):
    return graph.midpoints(graph.pairs_within(nodes(spark, d), 2.0))


@query(
    _pairs(
        "SELECT tree_a, tree_b, round(distance, 4) AS distance, node_a, node_b FROM (SELECT *, sqrt((ax - bx) ** 2 + (ay - by_) ** 2 + (az - bz) ** 2) AS distance FROM p) QUALIFY row_number() OVER (PARTITION BY tree_a, tree_b ORDER BY distance, node_a, node_b) = 1"
    )
)
def closest_pair(spark, d):
    return graph.closest_pairs(graph.pairs_within(nodes(spark, d), 2.0)).withColumn("distance", F.round("distance", 4))


def _order_chain(spark, d) -> DataFrame:
    """Consecutive orders of a customer."""
    after = F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("source"), after.alias("target")).where("target is not null")


_COMPONENTS = "SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders"


@query(f"SELECT node, component FROM ({_COMPONENTS}) WHERE n > 1")
def connected_components(spark, d):
    return graph.components(_order_chain(spark, d))


_AGGLOMERATES = f"SELECT node AS segment, dense_rank() OVER (ORDER BY component) AS agglomerate, row_number() OVER (PARTITION BY component ORDER BY node) - 1 AS position FROM ({_COMPONENTS})"


@query(_AGGLOMERATES)
def agglomerate_members(spark, d):
    segments = table(spark, d, "orders").select(F.col("o_orderkey").alias("segment"))
    return graph.agglomerates(segments, _order_chain(spark, d)).select(*longs("segment", "agglomerate", "position"))


@query(
    f"SELECT agglomerate, n AS n_segments, n - 1 AS n_edges, (sum(n) OVER w - n)::BIGINT AS segment_offset, (sum(n - 1) OVER w - (n - 1))::BIGINT AS edge_offset FROM (SELECT agglomerate, count(*) AS n FROM ({_AGGLOMERATES}) GROUP BY 1) WINDOW w AS (ORDER BY agglomerate)"
)
def agglomerate_csr_offsets(spark, d):
    segments = table(spark, d, "orders").select(F.col("o_orderkey").alias("segment"))
    chain = _order_chain(spark, d)
    out = graph.agglomerate_offsets(graph.agglomerates(segments, chain), chain)
    return out.select(*longs("agglomerate", "n_segments", "n_edges", "segment_offset", "edge_offset"))


_REPRESENT = (
    ", u AS (SELECT n.tree, n.node, s.v AS segment FROM nodes n JOIN vox s ON n.x = s.x AND n.y = s.y AND n.z = s.z WHERE s.v <> 0), "
    "f AS (SELECT tree, arg_min(segment, node) AS mapped FROM u GROUP BY 1), r AS (SELECT segment AS id, arg_min(mapped, tree) AS mapped FROM u JOIN f USING (tree) GROUP BY 1) "
)


@query(sql("nodes", "vox", then=_REPRESENT + "SELECT * FROM r").replace(") , u AS", "), u AS"))
def merger_mode_map(spark, d):
    return graph.representatives(nodes(spark, d), vox(spark, d))


@query(sql("nodes", "vox", then=_REPRESENT + "SELECT x, y, z, coalesce(mapped, v)::BIGINT AS v FROM vox LEFT JOIN r ON v = id").replace(") , u AS", "), u AS"))
def remap_segments(spark, d):
    v = vox(spark, d)
    return region.apply_mapping(v, graph.representatives(nodes(spark, d), v), missing="keep")


@query(
    "WITH a AS (SELECT s_suppkey AS tree, s_name AS name FROM supplier), b AS (SELECT c_custkey AS tree, c_name AS name FROM customer), top AS (SELECT max(tree) AS m FROM (SELECT tree FROM a UNION ALL SELECT tree FROM b)) "
    "SELECT tree, name, tree AS old_tree FROM a UNION ALL SELECT tree, name, tree FROM b WHERE tree NOT IN (SELECT tree FROM a) "
    "UNION ALL SELECT (SELECT m FROM top) + row_number() OVER (ORDER BY tree), name, tree FROM b WHERE tree IN (SELECT tree FROM a)"
)
def merge_trees_reid(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("tree"), F.col("s_name").alias("name"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("tree"), F.col("c_name").alias("name"))
    return graph.merge_trees(a, b).select(*longs("tree"), "name", *longs("old_tree"))


_GROUPS = (
    "groups AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation "
    "UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer)"
)


def _groups(spark, d) -> DataFrame:
    part = lambda t, key, parent, name: table(spark, d, t).select(key.alias("id"), parent.alias("parent"), F.col(name).alias("name"))
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return (
        part("region", tag("r", "r_regionkey"), F.lit(None).cast("string"), "r_name")
        .unionByName(part("nation", tag("n", "n_nationkey"), tag("r", "n_regionkey"), "n_name"))
        .unionByName(part("customer", tag("c", "c_custkey"), tag("n", "c_nationkey"), "c_name"))
    )


@query(
    f"WITH RECURSIVE {_GROUPS}, t AS (SELECT id, id AS root, 0 AS depth, name AS path FROM groups WHERE parent IS NULL UNION ALL SELECT g.id, t.root, t.depth + 1, t.path || '/' || g.name FROM groups g JOIN t ON g.parent = t.id) SELECT id, root, depth::BIGINT AS depth FROM t"
)
def group_flatten(spark, d):
    return graph.flattened(_groups(spark, d)).select("id", "root", *longs("depth"))


@query(
    f"WITH RECURSIVE {_GROUPS}, t AS (SELECT id, name AS path FROM groups WHERE parent IS NULL UNION ALL SELECT g.id, t.path || '/' || g.name FROM groups g JOIN t ON g.parent = t.id) SELECT id, path FROM t"
)
def folder_paths(spark, d):
    return graph.flattened(_groups(spark, d)).select("id", "path")


@query(
    "WITH o AS (SELECT c_custkey, c_nationkey, n_regionkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) "
    "SELECT 'c' || c_custkey AS id, n::BIGINT AS n FROM o UNION ALL SELECT 'n' || c_nationkey, sum(n)::BIGINT FROM o GROUP BY c_nationkey UNION ALL SELECT 'r' || n_regionkey, sum(n)::BIGINT FROM o GROUP BY n_regionkey"
)
def total_node_counts(spark, d):
    orders = table(spark, d, "orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return graph.subtree_sums(_groups(spark, d), orders, "n")


@query(
    "(SELECT tree, node, x, 'left' AS side FROM (SELECT l_orderkey AS tree, l_linenumber AS node, l_partkey AS x FROM lineitem WHERE l_returnflag <> 'N' EXCEPT ALL SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linestatus = 'F')) "
    "UNION ALL (SELECT tree, node, x, 'right' FROM (SELECT l_orderkey AS tree, l_linenumber AS node, l_partkey AS x FROM lineitem WHERE l_linestatus = 'F' EXCEPT ALL SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag <> 'N'))"
)
def tree_equality(spark, d):
    rows = table(spark, d, "lineitem")
    pick = lambda df: df.select(F.col("l_orderkey").alias("tree"), F.col("l_linenumber").alias("node"), F.col("l_partkey").alias("x"))
    return graph.difference(pick(rows.where("l_returnflag <> 'N'")), pick(rows.where("l_linestatus = 'F'")))


@query()
def spanning_links(spark, d):
    return graph.spanning_links(graph.closest_pairs(graph.pairs_within(nodes(spark, d), 2.0)))


# --- catalogue and administration --------------------------------------------


@query("SELECT doc_id, source, lang FROM documents WHERE source = 'src3' AND (lang = 'fr' OR source = 'src1')")
def dataset_filter_tags(spark, d):
    docs = table(spark, d, "documents").withColumn("tags", F.array("lang", "source"))
    return catalog.filter_datasets(docs, name=("source", "src3"), tags=["fr", "src1"]).select("doc_id", "source", "lang")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src2'")
def dataset_filter_all_tags(spark, d):
    docs = table(spark, d, "documents").withColumn("tags", F.array("lang", "source"))
    return catalog.filter_datasets(docs, tags=["en", "src2"], match="all").select("doc_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000 OFFSET 2000")
def task_page(spark, d):
    return catalog.page(table(spark, d, "orders"), ["o_orderkey"], 1000, 2).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING'")
def annotation_by_owner(spark, d):
    owners = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return catalog.owned(table(spark, d, "orders").where("o_orderstatus = 'F'"), "o_custkey", owners, "c_custkey").select("o_orderkey", "c_name")


_DAYS = [f"d{i:02d}" for i in range(1, 31)]


@query(
    "SELECT user_id, " + ", ".join(f"round(coalesce(sum(value) FILTER (day(ts) = {i}), 0), 4) AS d{i:02d}" for i in range(1, 31)) + " FROM events GROUP BY user_id HAVING sum(value) IS NOT NULL"
)
def user_times_pivot(spark, d):
    times = table(spark, d, "events").select("user_id", F.concat(F.lit("d"), F.lpad(F.dayofmonth("ts"), 2, "0")).alias("day"), "value")
    wide = aggregate.pivoted_times(times, "user_id", "day", "value", _DAYS)
    return wide.select("user_id", *[F.round(c, 4).alias(c) for c in _DAYS])


@query("SELECT user_id, year(ts)::BIGINT AS year, month(ts)::BIGINT AS month, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def logged_time_per_month(spark, d):
    return catalog.per_month(table(spark, d, "events"), "user_id", "ts", "value")


@query("SELECT l_orderkey AS layer, list_sort(list(DISTINCT 1 << (l_linenumber - 1)))[1]::BIGINT AS finest, (1 << (max(l_linenumber) - 1))::BIGINT AS coarsest, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1")
def mag_summary(spark, d):
    mags = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("layer"), F.expr("shiftleft(1L, l_linenumber - 1)").alias("m"))
    return catalog.mag_summary(mags.select("layer", F.col("m").alias("x"), F.col("m").alias("y"), F.col("m").alias("z"))).select("layer", *longs("finest", "coarsest", "n"))


# --- scalars -----------------------------------------------------------------


@query("SELECT p_partkey, round(p_retailprice * 1000.0::DOUBLE, 6) AS nm, round(p_retailprice * 1000.0::DOUBLE / 1e6::DOUBLE, 9) AS mm FROM part")
def unit_conversion(spark, d):
    um = F.lit("µm")
    return table(spark, d, "part").select(
        "p_partkey", F.round(scalars.to_nanometer(F.col("p_retailprice"), um), 6).alias("nm"), F.round(scalars.convert_length(F.col("p_retailprice"), um, "mm"), 9).alias("mm")
    )


@query(
    "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'uint8' WHEN 1 THEN 'float32' ELSE 'uint16' END AS dtype, CASE p_size % 3 WHEN 0 THEN 'uint24' WHEN 1 THEN 'float' ELSE 'uint16' END AS element_class FROM part"
)
def element_classes(spark, d):
    kind = F.col("p_size") % 3
    named = F.when(kind == 0, F.lit("uint24")).when(kind == 1, F.lit("float")).otherwise("uint16")
    channels = F.when(kind == 0, F.lit(3)).otherwise(1)
    rows = table(spark, d, "part").select("p_partkey", named.alias("e"), channels.alias("c"))
    dtype = scalars.channel_dtype(F.col("e"), F.col("c"))
    return rows.select("p_partkey", dtype.alias("dtype"), "c").select("p_partkey", "dtype", scalars.element_class(F.col("dtype"), F.col("c")).alias("element_class"))


@query("SELECT doc_id, u.s AS \"start\", least(u.s + 1000, n_chars) AS \"end\" FROM documents, LATERAL (SELECT unnest(range(0, n_chars, 1000)) AS s) u")
def resumable_chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.inline(scalars.byte_ranges(F.col("n_chars"), 1000)))


@query("SELECT page_id, 'a/' || page_id AS path, 'layerName' || page_id AS name FROM pages")
def path_and_name_functions(spark, d):
    raw = F.concat(F.lit("a/./b/../"), F.col("page_id").cast("string"), F.lit("/"))
    snake = F.concat(F.lit("layer_name"), F.col("page_id").cast("string"))
    return table(spark, d, "pages").select("page_id", scalars.normal_path(raw).alias("path"), scalars.snake_to_camel(snake).alias("name"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def metadata_parse(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# --- relational forms of what the array operators do -------------------------


@query(sql("boxes", then="SELECT DISTINCT x // 256 AS cx, y // 64 AS cy, z // 8 AS cz FROM (SELECT unnest(range(x0 // 256 * 256, x1, 256)) AS x, y0 AS y, z0 // 8 * 8 AS z FROM boxes)"))
def overlapping_chunks(spark, d):
    return region.touching_chunks(boxes(spark, d), (256, 64, 8), []).distinct()


@query(sql("seg", then="SELECT DISTINCT v AS segment FROM seg WHERE v NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)"))
def missing_segments(spark, d):
    known = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("v"))
    return seg(spark, d).select("v").distinct().join(known, "v", "left_anti").withColumnRenamed("v", "segment")


@query("SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_totals(spark, d):
    return table(spark, d, "lineitem").cube(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query(sql("seg", then="SELECT v AS segment, count(*) AS n FROM seg WHERE v <> 0 GROUP BY 1 ORDER BY n DESC, segment LIMIT 20"))
def top_segments(spark, d):
    return aggregate.segment_sizes(seg(spark, d)).select("segment", "n").orderBy(F.desc("n"), "segment").limit(20)


@query(
    "SELECT o_orderkey, arg_max(event_id, ts) AS event_id FROM (SELECT o_orderkey, o_custkey, TIMESTAMP '2024-01-01' + (o_orderkey % 40) * INTERVAL 1 DAY AS at FROM orders) o JOIN events e ON e.user_id = o.o_custkey AND e.ts <= o.at AND event_type = 'view' GROUP BY 1"
)
def asof_join(spark, d):
    at = F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(cast(o_orderkey % 40 as int))")
    left = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), at.alias("at"))
    right = table(spark, d, "events").where("event_type = 'view'").select("user_id", F.col("ts").alias("at"), "event_id")
    return catalog.asof(left, right, "user_id", "at", "event_id").where("event_id is not null").select("o_orderkey", "event_id")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, d):
    w = F.window("ts", "1 day")
    return table(spark, d, "events").groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


# --- formats: written to the shared folder and read back ----------------------

_STORED = sql("vox", then="SELECT * FROM vox WHERE v <> 0")


def _extent(v: DataFrame) -> tuple[int, int, int]:
    found = aggregate.bounding_box(v).first()
    return tuple(found[c] or 1 for c in ("x1", "y1", "z1"))


@query(_STORED)
def zarr3_roundtrip(spark, d):
    path = new_path(spark, "zarr3")
    arrays.write_zarr3(points(spark, d), path, None, "uint16", (32, 32, 8), (128, 128, 8), merge="max")
    return arrays.read_array(spark, path)


@query(_STORED)
def zarr2_roundtrip(spark, d):
    v, path = vox(spark, d), new_path(spark, "zarr2")
    arrays.write_zarr2(v, path, None, "<u2", (128, 128, 8))
    return arrays.read_array(spark, path)


@query(_STORED)
def wkw_roundtrip(spark, d):
    path = new_path(spark, "wkw")
    arrays.write_wkw(points(spark, d), path, "uint8", 32, 4, merge="max")
    return arrays.read_array(spark, path)


_PARTS = "SELECT x, y, z, v / 8.0::DOUBLE AS v FROM vox WHERE v <> 0"


@query(sql("vox", then=_PARTS))
def float_roundtrip(spark, d):
    """Values with fractions through a float32 array."""
    v, path = points(spark, d), new_path(spark, "float")
    arrays.write_zarr3(v.withColumn("v", F.col("v") / 8), path, None, "float32", (32, 32, 8), (128, 128, 8), merge="max")
    return arrays.read_array(spark, path)


@query(sql("vox", "vox_r", then="SELECT 0::BIGINT AS c, * FROM vox WHERE v <> 0 UNION ALL SELECT 1::BIGINT, * FROM vox_r WHERE v <> 0"))
def channel_roundtrip(spark, d):
    v, path = points(spark, d), new_path(spark, "channels")
    both = v.withColumn("c", F.lit(0)).unionByName(points(spark, d, "R").withColumn("c", F.lit(1)))
    arrays.write_wkw(both, path, "uint8", 32, 2, channels=2, merge="max")
    return arrays.read_array(spark, path, channel=None)


@query(sql("vox", then="SELECT v % 3 AS t, v % 2 AS c, x, y, z, v FROM vox WHERE v <> 0"))
def nd_read(spark, d):
    """An array of time, channel and space; all points of all axes."""
    v, path = region.merged(points(spark, d), (64, 64, 8)), new_path(spark, "nd")
    spread = v.withColumns({"t": F.col("v") % 3, "c": F.col("v") % 2})
    arrays.write_zarr3(spread, path, None, "uint16", (32, 32, 8), (64, 64, 8), extra={"t": 3, "c": 2}, separator=".")
    return arrays.read_array(spark, path, channel=None)


@query(sql("vox", then="SELECT * FROM vox WHERE v <> 0 AND x >= 100 AND x < 300 AND y >= 10 AND y < 60 AND z >= 2 AND z < 6"))
def read_bbox_zarr3(spark, d):
    """A box of a stored array: only the files that it touches are read."""
    path, box = new_path(spark, "zarr3"), Box.of((100, 10, 2), (200, 50, 4))
    arrays.write_zarr3(points(spark, d), path, None, "uint16", (32, 32, 8), (128, 128, 8), merge="max")
    return region.read(arrays.read_array(spark, path, box=box), box)


@query(sql("vox", then="SELECT v % 2 AS c, x // 2 AS x, y // 2 AS y, z // 2 AS z, max(v / 8.0::DOUBLE) AS v FROM vox WHERE v <> 0 GROUP BY ALL"))
def downsample_max_channels(spark, d):
    """Floating values of two channels, each on its own."""
    return resample.downsample(vox(spark, d).select(*AXES, (F.col("v") % 2).alias("c"), (F.col("v") / 8).alias("v")), 2, "max")


@query(sql("vox", then=f", {_NEAREST}{_TILES}").replace(") , taps", "), taps"))
def downsample_nearest(spark, d):
    return resample.resample_tiles(vox(spark, d), 2, "nearest")


@query(_STORED)
def cube_roundtrip(spark, d):
    path = new_path(spark, "cubes")
    volumes.write_cubes(points(spark, d), path, merge="max")
    return volumes.read_cubes(spark, path)


@query(sql("vox", then="SELECT x, y, z - (SELECT min(z) FROM vox WHERE v <> 0) AS z, v FROM vox WHERE v <> 0"))
def tiff_roundtrip(spark, d):
    """Slices are numbered by their place among the files, so z begins at 0."""
    v, path = vox(spark, d), new_path(spark, "tiff")
    volumes.write_tiff_slices(v, path, _extent(v)[:2])
    return volumes.read_tiff_stack(spark, path)


@query(sql("nodes", then="SELECT tree, node, x, y, z FROM nodes"))
def nml_roundtrip(spark, d):
    """Trees spread over files by their id; each file is one task's work."""
    path = new_path(spark, "nml")
    n = nodes(spark, d)
    file = F.concat(F.lit("part"), F.floor(F.col("tree") / 1000).cast("string"))
    nml.write(nml.assemble(n.withColumn("file", file).withColumnRenamed("node", "id"), edges(n).withColumn("file", file)), path)
    back = nml.tables(nml.read(spark, path))["nodes"]
    return back.select("tree", F.col("id").alias("node"), *[F.col(a).cast("long").alias(a) for a in AXES])


@query(_STORED)
def stream_ingest(spark, d):
    """Slices as files of a stream, taken in three at a time."""
    source, target = new_path(spark, "slices"), new_path(spark, "ingested")
    vox(spark, d).repartition(8, "z").write.parquet(source)
    slices.ingest(spark, source, target, new_path(spark, "progress"), 3).awaitTermination()
    return spark.read.parquet(target).select(*AXES, "v")
